"""Scores of answered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame, by: str) -> DataFrame:
    return predictions.groupBy(by).agg(F.sum("correct").alias("correct"), F.count("*").alias("total"))


def pair_scores(predictions: DataFrame) -> DataFrame:
    """One row: the share of units all right, and units with exactly one right over units with at least one."""
    units = predictions.groupBy("unit").agg(F.sum("correct").alias("right"), F.count("*").alias("n"))
    right = F.col("right")
    one, any_ = F.sum(F.when(right == 1, 1).otherwise(0)), F.sum(F.when(right >= 1, 1).otherwise(0))
    return units.agg(F.count("*").alias("units"), F.avg((right == F.col("n")).cast("double")).alias("pair_accuracy"), (one / any_).alias("bir"))


def with_options(question: Column, options: Column) -> Column:
    """The question and its options, sorted, a line each."""
    return F.concat(question, F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit("\n"), e["key"], F.lit(") "), e["value"])), ""))


def unanswered(questions: DataFrame, answered: DataFrame, key: str = "question_id") -> DataFrame:
    """What a resumed run still has to answer."""
    return questions.join(answered.select(key), key, "left_anti")
