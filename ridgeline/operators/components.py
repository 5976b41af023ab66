"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import SMALL, discard, join_split, written


def _sum_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
    return r.n, r.s


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable.

    Each round rewires neighbours to the least one they know and is written to the
    shared folder; only a count and a checksum reach the driver. Minima are
    combined before they are shuffled and joined back with hot nodes split, so a node
    with very many edges does not meet in one task. Rounds grow as the logarithm of a
    component's diameter; labels that have not settled are an error, never a result.
    Loops and null ends: no edge.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    before = _sum_of(e)
    for r in range(max_rounds):
        # Few edges: no hot node can fill a task, and one job does both stars.
        split = before[0] > SMALL // 2
        join = join_split if split else (lambda many, one, key: many.join(one, key))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join(both, least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"large{r}") if split else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, written(small, f"edges{r + 1}")
        discard(last, large)
        now = _sum_of(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
