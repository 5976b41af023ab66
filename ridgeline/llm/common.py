"""Helpers that the operators share: tables, words, shared storage, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, join_split
from ..storage import written as materialize

__all__ = ["bound", "bucket_of", "discard", "fixed", "guarded", "join_split", "materialize", "n_words", "range_splits", "table", "trimmed", "words"]

#: White space of the word rules here (space, tab, LF, VT, FF, CR), as a Java class body.
SPACE = r" \t-\r"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guarded(docs: DataFrame, needed: tuple) -> tuple:
    """docs with all columns but the needed ones under names that no operator uses, and the way back.

    back(out) gives the old names to the columns again. So an operator's own columns,
    inner or returned, never meet a column of the input.
    """
    other = [c for c in docs.columns if c not in needed]
    hidden = {c: f"kept__{i}" for i, c in enumerate(other)}

    def back(out: DataFrame, added: tuple = ()) -> DataFrame:
        """The columns of docs, those that clash with added ones left out, and the added ones."""
        taken = {a.lower() for a in added}
        held = [F.col(hidden.get(c, c)).alias(c) for c in docs.columns if c.lower() not in taken]
        return out.select(*held, *added)

    return docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]), back


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank: empty."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    """Their number, as a long."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE}]+"))).cast("long")


def range_splits(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending cut points of a numeric column, from one aggregate.

    They only balance the parts, so approximate quantiles do.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    points = F.split(F.lit(",".join(map(str, at))), ",").cast("array<double>")
    got = df.agg(F.percentile_approx(F.col(column), points, F.lit(max(10_000, 10 * parts))).alias("q")).head()
    return sorted({x for x in (got.q if got and got.q else []) if x is not None})


def bound(value: Column, use) -> Column:
    """use(value), with value computed once; in a lambda a plain column would be computed at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed(df: DataFrame, columns: dict) -> DataFrame:
    """Adds columns that are computed once, whatever uses and filters follow.

    Filters are pushed below plain projections, and expressions are then computed
    again or, in a lambda, for every element; nothing is pushed below a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def bucket_of(value: Column, splits: list) -> Column:
    """The number of splits at most the value, by binary search; nulls go to -1."""
    if not splits:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table = F.split(F.lit(",".join(str(int(x)) for x in splits)), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]

    def step(pos: Column, width: Column) -> Column:
        at = pos + width
        return F.when((at <= len(splits)) & (F.get(table, F.least(at, F.lit(len(splits))) - 1) <= value), at).otherwise(pos)

    return F.when(value.isNull(), F.lit(-1)).otherwise(F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step))
