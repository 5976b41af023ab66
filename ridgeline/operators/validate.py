"""Violations as rows: rules, references, ids, hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict, key: Column) -> DataFrame:
    """(rule, key) for every row that breaks a rule; a rule that is null counts as broken. One pass over df."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), key.alias("key"))


def assert_valid(df: DataFrame, rules: dict, key: Column) -> DataFrame:
    """df itself, or ValueError with a few of its violations."""
    found = violations(df, rules, key).limit(5).collect()
    if found:
        raise ValueError(f"invalid rows: {[(r.rule, r.key) for r in found]}")
    return df


def dangling(df: DataFrame, key: str, others: DataFrame, reference: str, name: str) -> DataFrame:
    """Keys that nothing refers to, or the reverse: a left anti-join."""
    return df.join(others.select(F.col(reference).alias(key)), key, "left_anti").select(F.lit(name).alias("reference"), F.col(key).alias("key"))


def duplicates(df: DataFrame, key: list) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _link(previous: Column, group: Column, sequence: Column, payload: Column) -> Column:
    """The digest of a row: of the digest before it and of its own content, so that a change shows in every later row."""
    return F.sha2(F.concat_ws("|", previous, group, sequence.cast("string"), payload).cast("binary"), 256)


def chained(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, sequence, payload, ...) with own, the digest of the row and of all before it, and previous, the digest before.

    Each digest needs the one before, so a group's rows are folded in order as one array; groups are the ledgers of one video.
    """
    rest = [c for c in rows.columns if c not in (group, "sequence")]
    held = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("sequence", *rest))).alias("rows"))

    start = F.array(F.lit(""))
    digests = F.aggregate("rows", start, lambda acc, r: F.concat(acc, F.array(_link(F.element_at(acc, -1), F.col(group), r["sequence"], r["payload"]))))
    d = held.withColumn("digests", digests).select(group, "digests", F.posexplode("rows").alias("place", "row"))
    return d.select(group, "row.sequence", *[f"row.{c}" for c in rest], F.get("digests", F.col("place") + 1).alias("own"), F.get("digests", F.col("place")).alias("previous"))


def broken_links(chain: DataFrame, group: str, changed: Column) -> DataFrame:
    """(group, sequence, fault): rows whose content or link no longer fits their digest, whose sequence has a gap, or whose
    link is not the digest before. changed: rows whose payload is altered first, to test the check. Row by row, with one look back."""
    c = chain.withColumn("payload", F.when(changed, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    w = Window.partitionBy(group).orderBy("sequence")
    own = _link(F.col("previous"), F.col(group), F.col("sequence"), F.col("payload"))
    fault = F.when(own != F.col("own"), "payload").when(F.col("sequence") != F.row_number().over(w), "sequence").when(F.col("previous") != F.coalesce(F.lag("own").over(w), F.lit("")), "link")
    return c.select(group, "sequence", fault.alias("fault")).where("fault IS NOT NULL")
