"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, join_split, materialize, n_words, table

#: Hex digits of the seeded hash that split a source: 4096 parts.
PART_DIGITS = 3


#: Sources up to which their one row each is broadcast.
FEW_SOURCES = 2000


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Adds key__ of the source, hash__ and part__ of the row, and tie__. Rows without an id are told apart by text."""
    name = F.coalesce(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")), F.concat(F.lit(f"{seed}|?"), F.coalesce("text", F.lit(""))))
    hashed = F.md5(name.cast("binary"))
    return docs.select("*", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key__"), hashed.alias("hash__"), F.substring(hashed, 1, PART_DIGITS).alias("part__"), F.xxhash64("text").alias("tie__"))


def source_targets(parts: DataFrame, weights: tuple, epochs: int) -> DataFrame:
    """parts: sizes by _key, source and part. One row a source: its size, weight and target.

    Sources sorted by the level at which they reach their cap are clamped in
    that order as long as the level that the rest would share is as high; that
    is where clamping and resharing the excess, round after round, comes to rest.
    The windows run over one row a source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = parts.groupBy("key__").agg(F.first("source").alias("source"), F.sum("part_size").cast("long").alias("source_size"))
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights)))))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_level", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_level", "_rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_share", F.col("_left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_clamped", F.col("_level") <= F.col("_share"))
    s = s.withColumn("_first", F.min(F.when(~F.col("_clamped"), F.struct("_level", "_rank", "_share"))).over(whole)["_share"])
    target = F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.least(F.col("weight") * F.col("_first"), F.col("_cap")))
    return s.select("key__", "source_size", "weight", target.alias("target"))


def mixed(keyed: DataFrame, size: Column, weights: tuple, epochs: int) -> DataFrame:
    """Adds size__, source_size, target, copies and taken to rows with key__, hash__, part__ and tie__; size: an expression over a row."""
    parts = materialize(keyed.groupBy("key__", "part__").agg(F.first("source").alias("source"), F.sum(size).alias("part_size")), "parts")
    targets = source_targets(parts, weights, epochs)
    whole: Column = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    upto = Window.partitionBy("key__").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("offset__", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).join(targets, "key__").withColumn("whole__", whole)
    placed = placed.withColumn("need__", F.col("target") - F.col("whole__") * F.col("source_size"))
    # In order of the hash a source's rows are taken up to a point: its parts before edge__ wholly, that one in part, the others not.
    open_part = F.when(F.col("offset__") + F.col("part_size") > F.col("need__"), F.struct("part__", "offset__"))
    info = placed.groupBy("key__").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole__", "need__")], F.min(open_part).alias("edge__"))
    info = materialize(info.select("key__", "source_size", "target", "whole__", "need__", F.col("edge__.part__").alias("edge__"), F.col("edge__.offset__").alias("offset__")), "sources")
    rows = keyed.join(F.broadcast(info), "key__") if info.count() <= FEW_SOURCES else join_split(keyed, info, "key__")
    at_edge = F.coalesce(F.col("part__") == F.col("edge__"), F.lit(False))
    outside = rows.where(~at_edge).withColumn("size__", size).withColumn("extra__", F.coalesce(F.col("part__") < F.col("edge__"), F.lit(True)))
    within = Window.partitionBy("key__").orderBy("hash__", "doc_id", "size__", "tie__").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(at_edge).withColumn("size__", size).withColumn("before__", F.col("offset__") + F.coalesce(F.sum("size__").over(within), F.lit(0)))
    inside = inside.withColumn("extra__", 2.0 * F.col("before__") + F.col("size__") < 2.0 * F.col("need__")).drop("before__")
    out = outside.unionByName(inside).withColumn("copies", F.col("whole__") + F.when(F.col("extra__") & (F.col("size__") > 0), 1).otherwise(0).cast("long"))
    return out.withColumn("size", F.col("size__")).withColumn("taken", F.col("copies") * F.col("size__"))


ADDED = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Each document with how often the mix takes it.

    Adds size (words), source_size, target, copies and taken (copies * size).
    Sources in order of code points, null last, get the weights in turn. A
    source's whole repetitions go to all its documents; the fractional one goes
    to documents in order of a seeded hash until its words are reached, which
    misses the target by at most half of one document. Prefix sums are taken over
    4096 hash parts of a source, and row by row only within the one part where the words are reached:
    texts of the others are not shuffled, and no source meets in one task.

    Null text: size 0. Null source: a source of its own. Null doc_id: told apart by
    text. Repeated rows stay rows of their own; of equal ones, as many as are needed are taken.
    Empty table: empty result. Other columns stay; those with the names of added ones are
    replaced, inner names clash with none.
    """
    plain, back = guarded(docs, ("doc_id", "text", "source"))
    return back(mixed(_keyed(plain, seed), n_words(F.col("text")), weights, epochs), ADDED)


def sizes(docs: DataFrame, weights: tuple = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The same without texts: words are counted once and written with the ids. Columns doc_id and those added."""
    slim = _keyed(docs.select("doc_id", "text", "source"), seed).select("doc_id", "source", "key__", "hash__", "part__", "tie__", n_words(F.col("text")).alias("n__"))
    return mixed(materialize(slim, "sizes"), F.col("n__"), weights, epochs).select("doc_id", *ADDED)


def repeated(mixed: DataFrame, columns: list) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy__")).select(*columns)


def op10_mix_sources(spark, sf_dir):
    """All documents mixed by weights 5, 2, 1 in turn, at most three epochs a source."""
    return sizes(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s0),
s2 AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS lvl FROM s2),
s4 AS (SELECT *,
         (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY lvl, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS remaining,
         sum(w) OVER (ORDER BY lvl, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM s3),
s5 AS (SELECT *, remaining / wrest AS share FROM s4),
s6 AS (SELECT *, lvl <= share AS clamped FROM s5),
f AS (SELECT arg_min(share, struct_pack(l := lvl, r := rk)) AS share FROM s6 WHERE NOT clamped),
t AS (SELECT s6.source, s6.source_size, CASE WHEN clamped THEN cap ELSE least(w * f.share, cap) END AS target FROM s6 LEFT JOIN f ON true),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND 2.0::DOUBLE * before + size < 2.0::DOUBLE * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
