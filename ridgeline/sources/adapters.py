"""The driver's tables in the shape of evidence tables, in Spark and as SQL."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """A zone-less timestamp as microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


#: Event types by the kind of fact they stand for; all others are texts.
KIND_OF = {"click": "event", "purchase": "event", "view": "state", "signup": "attribute"}


def _at(micros: float, up: bool):
    """A whole microsecond as a zone-less timestamp literal, for bounds on the column itself."""
    whole = math.ceil(micros) if up else math.floor(micros)
    return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=whole))).cast("timestamp_ntz")


def scanned(e: DataFrame, q) -> DataFrame:
    """events with what a search asks of ids, kinds, windows and times as conditions on the columns of the file, so that the scan can skip."""
    if q.ids:
        numbers = [int(i[1:]) for i in q.ids if re.fullmatch(r"F[0-9]{1,18}", i)]
        e = e.where(F.col("event_id").isin(*numbers))
    if q.kinds and "text" not in q.kinds:
        e = e.where(F.col("event_type").isin(*[t for t, k in KIND_OF.items() if k in q.kinds]))
    starts = [q.start] if q.start is not None else []
    ends = [q.end] if q.end is not None else []
    if q.windows:
        starts, ends = [*starts, min(q.windows) * HOUR], [*ends, (max(q.windows) + 1) * HOUR]
    if starts:
        e = e.where(F.col("ts") >= _at(max(starts), True))
    if ends:
        e = e.where(F.col("ts") <= _at(min(ends), False))
    return e


def facts(spark: SparkSession, sf_dir: str, q=None) -> DataFrame:
    """events as facts: one agent, one object, a point in time, an hour as window; q: a search whose scan conditions go to the file."""
    e = read(spark, sf_dir, "events")
    e = e if q is None else scanned(e, q)
    kind = F.when(F.col("event_type").isin("click", "purchase"), "event").when(F.col("event_type") == "view", "state").when(F.col("event_type") == "signup", "attribute").otherwise("text")
    out = e.select(
        F.concat(F.lit("F"), F.col("event_id").cast("string")).alias("fact_id"), kind.alias("kind"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("agent"), F.concat(F.lit("O"), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("object"),
        micros("ts").alias("t0"), F.col("value"),
    )
    return out.withColumn("t1", F.col("t0")).withColumn("win", F.floor(F.col("t0") / F.lit(HOUR)).cast("long"))


FACTS = """facts_v AS (
  SELECT 'F' || event_id AS fact_id,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'event' WHEN event_type = 'view' THEN 'state' WHEN event_type = 'signup' THEN 'attribute' ELSE 'text' END AS kind,
    event_type AS predicate, 'P' || user_id AS agent, 'O' || regexp_extract(props, '"k": *([0-9]+)', 1) AS object,
    epoch_us(ts) AS t0, epoch_us(ts) AS t1, value, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS win
  FROM events)"""


def roles(held: DataFrame) -> DataFrame:
    """Two rows a fact: agent and patient."""
    pairs = F.array(F.struct(F.lit("agent").alias("role"), F.col("agent").alias("entity")), F.struct(F.lit("patient").alias("role"), F.col("object").alias("entity")))
    return held.select("fact_id", "kind", "predicate", "t0", "win", F.inline(pairs))


ROLES = """roles_v AS (
  SELECT fact_id, kind, predicate, t0, win, 'agent' AS role, agent AS entity FROM facts_v
  UNION ALL SELECT fact_id, kind, predicate, t0, win, 'patient', object FROM facts_v)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    at = F.col("turn") * 10
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"), "conv_id", "turn", at.alias("start"), (at + 8).alias("end"), F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("speaker"), "text")


UTTERANCES = """utterances_v AS (
  SELECT conv_id || ':' || turn AS utterance_id, conv_id, turn, turn * 10 AS start, turn * 10 + 8 AS "end", conv_id || ':' || role AS speaker, text FROM conversations)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes in frames, in integer thousandths."""
    x1, y1 = F.col("l_partkey") % 20 * 20, F.col("l_suppkey") % 20 * 20
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("instance"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 300 + F.round(F.col("l_discount") * 1000).cast("long")).alias("x2"), (y1 + 300 + F.round(F.col("l_tax") * 1000).cast("long")).alias("y2"),
    )


BOXES = """boxes_v AS (
  SELECT frame, instance, line, part, x1, y1, x1 + 300 + d AS x2, y1 + 300 + t AS y2 FROM (
    SELECT l_orderkey AS frame, 'P' || l_suppkey AS instance, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_partkey % 20 * 20 AS x1, l_suppkey % 20 * 20 AS y1,
      CAST(round(l_discount * 1000) AS BIGINT) AS d, CAST(round(l_tax * 1000) AS BIGINT) AS t FROM lineitem))"""


def links(held: DataFrame) -> DataFrame:
    """Per agent, each day with events to the next: contradicted where the next one has an error."""
    from pyspark.sql import Window

    day = F.floor(F.col("t0") / F.lit(24 * HOUR)).cast("long")
    days = held.groupBy("agent", day.alias("day")).agg(F.max((F.col("predicate") == "error").cast("int")).alias("bad"))
    w = Window.partitionBy("agent").orderBy("day")
    n = days.withColumn("next_day", F.lead("day").over(w)).withColumn("next_bad", F.lead("bad").over(w)).where("next_day IS NOT NULL")
    verdict = F.when(F.col("next_bad") == 1, "contradicted").otherwise("supported")
    name = lambda d: F.concat_ws("@", "agent", F.col(d).cast("string"))
    return n.select(F.concat_ws(">", name("day"), F.col("next_day").cast("string")).alias("proposal_id"), name("day").alias("source"), name("next_day").alias("target"), verdict.alias("verdict"), "agent")


LINKS = """days_v AS (SELECT agent, CAST(t0 // 86400000000 AS BIGINT) AS day, max(CASE WHEN predicate = 'error' THEN 1 ELSE 0 END) AS bad FROM facts_v GROUP BY 1, 2),
next_v AS (SELECT *, lead(day) OVER w AS next_day, lead(bad) OVER w AS next_bad FROM days_v WINDOW w AS (PARTITION BY agent ORDER BY day)),
links_v AS (SELECT agent || '@' || day || '>' || next_day AS proposal_id, agent || '@' || day AS source, agent || '@' || next_day AS target,
  CASE WHEN next_bad = 1 THEN 'contradicted' ELSE 'supported' END AS verdict, agent FROM next_v WHERE next_day IS NOT NULL)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as answered questions in paired units: neighbours by doc_id, numbered over 256 ranges of ids and within each."""
    from pyspark.sql import Window

    held = read(spark, sf_dir, "labels")
    ends = held.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).head()
    low, high = ends.low or 0, ends.high or 0
    part = F.floor((F.col("doc_id") - low) * 256 / max(1, high - low + 1))
    held = held.withColumn("part", part)
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("start"))
    numbered = held.join(F.broadcast(starts), "part").withColumn("n", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1)
    unit = F.floor(F.col("n") / 2).cast("long")
    pairs = numbered.withColumn("unit", unit).withColumn("held", F.count("*").over(Window.partitionBy("unit"))).where("held = 2")
    return pairs.select(F.col("doc_id").alias("question_id"), "unit", F.concat(F.lit("R"), (F.col("doc_id") % 8).cast("string")).alias("binding_type"), F.col("quality").cast("int").alias("correct"))


PREDICTIONS = """predictions_v AS (
  SELECT doc_id AS question_id, unit, 'R' || (doc_id % 8) AS binding_type, CAST(quality AS INTEGER) AS correct FROM (
    SELECT *, count(*) OVER (PARTITION BY unit) AS held FROM (SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 2 AS BIGINT) AS unit FROM labels)) WHERE held = 2)"""
