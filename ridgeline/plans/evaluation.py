"""Queries that score paired questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normal_answer
from ..operators import evaluate
from ..sources.adapters import PREDICTIONS, predictions, read


def accuracy_by_type(spark, sf_dir):
    return evaluate.accuracy(predictions(spark, sf_dir), "binding_type")


def pair_accuracy_bir(spark, sf_dir):
    return evaluate.pair_scores(predictions(spark, sf_dir)).select("units", F.round("pair_accuracy", 9).alias("pair_accuracy"), F.round("bir", 9).alias("bir"))


def question_projection(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    options = F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.col("n_name"))
    return n.select("n_nationkey", evaluate.with_options(F.lit("Which nation?"), options).alias("question"))


def answer_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "labels")
    raw = F.element_at(F.array(F.lit("(B) yes"), F.lit(" true"), F.lit("c"), F.lit("FALSE."), F.lit("Answer: D"), F.lit("")), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 2 == 1, "true_false").otherwise("multiple_choice")
    return d.select("doc_id", normal_answer(raw, kind).alias("answer"))


def resumed_questions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return evaluate.unanswered(p.select("question_id", "unit"), p.where("correct = 1"))


QUERIES = [
    ("accuracy_by_type", accuracy_by_type, f"WITH {PREDICTIONS} SELECT binding_type, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total FROM predictions_v GROUP BY 1"),
    ("pair_accuracy_bir", pair_accuracy_bir, f"WITH {PREDICTIONS}, u AS (SELECT unit, sum(correct) AS r, count(*) AS n FROM predictions_v GROUP BY 1) SELECT count(*) AS units, round(avg(CASE WHEN r = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS pair_accuracy, round(count(*) FILTER (r = 1) / (count(*) FILTER (r >= 1))::DOUBLE, 9) AS bir FROM u"),
    ("question_projection", question_projection, "SELECT n_nationkey, 'Which nation?' || chr(10) || 'A) ' || n_name || chr(10) || 'B) no' AS question FROM nation"),
    ("answer_normalize", answer_normalize, "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'True' WHEN 2 THEN 'C' WHEN 3 THEN 'False' WHEN 4 THEN 'A' ELSE '' END AS answer FROM labels"),
    ("resumed_questions", resumed_questions, f"WITH {PREDICTIONS} SELECT question_id, unit FROM predictions_v WHERE correct <> 1"),
]
