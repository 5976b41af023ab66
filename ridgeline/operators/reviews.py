"""Reviews, audits and derived links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Running sums over time start anew so many times a gap.
BUCKETS = 32


def near_in_time(left: DataFrame, right: DataFrame, keys: list, gap: int) -> DataFrame:
    """Pairs of equal keys whose instants (t_left, t_right) are at most gap apart.

    Each right row stands in its bucket of width gap, each left row looks in three; the join is on keys and bucket.
    """
    b = F.floor(F.col("t_left") / gap)
    a = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    c = right.withColumn("_b", F.floor(F.col("t_right") / gap))
    return a.join(c, [*keys, "_b"]).where(F.abs(F.col("t_left") - F.col("t_right")) <= gap).drop("_b")


def candidate_status(pairs: DataFrame, mention: str, jersey: str, event_count: str) -> DataFrame:
    """One row a mention: accepted with one nearby jersey and one aligned event, provisional with one jersey, else ambiguous."""
    return _status(pairs.groupBy(mention).agg(F.countDistinct(jersey).alias("n"), F.max(event_count).alias("e")), mention)


def _status(g: DataFrame, mention: str) -> DataFrame:
    status = F.when((F.col("n") == 1) & (F.col("e") == 1), "accepted").when(F.col("n") == 1, "provisional_unique").otherwise("ambiguous")
    return g.select(mention, F.col("n").alias("nearby"), status.alias("status"))


def nearby_counts(left: DataFrame, right: DataFrame, keys: list, gap: int, name: str) -> DataFrame:
    """left (with instants t_left) and for each row, of the right rows with equal keys whose instants (t_right) are at most gap apart:
    _n, how many names they have (null is none), and _met, which is above 0 where there are any. Rows without a key or an instant are left out.

    No pairs are made. An instant is near to a name within spans of time, which are cut so that those of one name do not overlap;
    _n is the number of spans opened less those closed until then: sums of whole buckets before, and a running sum within the bucket.
    """
    bucket = F.floor(F.col("_t") / max(1, gap // BUCKETS)).alias("_b")
    a = left.dropna(subset=[*keys, "t_left"]).withColumn("_t", F.col("t_left")).select("*", bucket)
    c = right.dropna(subset=[*keys, "t_right"])
    # Rows without a name need no cut, as only whether there are any counts: they do not meet in one partition.
    own = F.coalesce(F.concat(F.lit("n"), F.col(name).cast("string")), F.col("t_right").cast("string"))
    last = F.lag("t_right").over(Window.partitionBy(*keys, own).orderBy("t_right"))
    spans = c.select(*keys, F.greatest(F.col("t_right") - gap, last + gap + 1).alias("_from"), (F.col("t_right") + gap + 1).alias("_to"), F.col(name).isNotNull().cast("long").alias("_n"))
    ends = [F.struct(F.col(at).alias("_t"), F.lit(by).cast("long").alias("_met"), (F.col("_n") * by).alias("_n")) for at, by in (("_from", 1), ("_to", -1))]
    steps = spans.select(*keys, F.inline(F.array(*ends))).select("*", bucket)
    zero = [F.lit(0).cast("long").alias("_met"), F.lit(0).cast("long").alias("_n")]
    totals = steps.select(*keys, "_b", "_met", "_n").union(a.select(*keys, "_b").distinct().select("*", *zero)).groupBy(*keys, "_b").agg(F.sum("_met").alias("_met"), F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_b", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_before{x}") for x in ("_met", "_n")])
    until = Window.partitionBy(*keys, "_b").orderBy("_t")  # up to and with equal instants
    both = a.select("*", *zero, F.lit(True).alias("_asked")).unionByName(steps.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    both = both.withColumns({x: F.sum(x).over(until) for x in ("_met", "_n")}).where("_asked").join(before, [*keys, "_b"])
    return both.select(*left.columns, *[(F.col(x) + F.col(f"_before{x}")).alias(x) for x in ("_met", "_n")])


def nearby_status(left: DataFrame, right: DataFrame, keys: list, gap: int, mention: str, jersey: str, event_count: str) -> DataFrame:
    """candidate_status of the pairs of near_in_time, from counts; only mentions that stand at several places, whose jerseys may be the same ones, are paired."""
    place = F.struct(*keys, "t_left")
    ends = [F.min(place).alias("first"), F.max(place).alias("last")]
    g = nearby_counts(left, right, keys, gap, jersey).groupBy(mention).agg(*ends, F.max("_met").alias("met"), F.max("_n").alias("n"), F.max(event_count).alias("e"))
    out = _status(g.where("met > 0 AND first = last"), mention)
    held = left.dropna(subset=[*keys, "t_left"])
    several = held.groupBy(mention).agg(*ends).where("first <> last").select(F.col(mention).alias("_several"))
    again = held.join(several, F.col(mention).eqNullSafe(F.col("_several")), "left_semi")
    return out.union(candidate_status(near_in_time(again, right, keys, gap), mention, jersey, event_count))


def gate(reviews: DataFrame, keys: list, stage: str, needed: tuple, denied: Column) -> DataFrame:
    """Whether each subject's reviews reach all needed stages and none denies it."""
    g = reviews.groupBy(*keys).agg(F.collect_set(stage).alias("stages"), F.bool_or(denied).alias("denied"))
    wanted = F.array(*[F.lit(x) for x in needed])
    passed = (F.size(F.array_except(wanted, F.col("stages"))) == 0) & ~F.col("denied")
    return g.select(*keys, F.size("stages").cast("long").alias("stages"), "denied", passed.alias("passed"))


def replacement_links(events: DataFrame, before: str, after: str, keys: list) -> DataFrame:
    """A contradiction link for each event of kind after that directly follows one of kind before: its id is a digest of both."""
    w = Window.partitionBy(*keys).orderBy("t0", "fact_id")
    d = events.withColumn("_p", F.lag("predicate").over(w)).withColumn("source", F.lag("object").over(w))
    d = d.where((F.col("predicate") == after) & (F.col("_p") == before) & (F.col("source") != F.col("object")))
    return d.select("fact_id", "source", F.col("object").alias("target"), F.substring(F.sha2(F.concat_ws("|", F.lit("replace"), "fact_id", "source", "object").cast("binary"), 256), 1, 20).alias("proposal_id"))


def rejected_facts(rejected: DataFrame, instances: DataFrame) -> DataFrame:
    """Rejected records as facts: the last part of a region id finds the instance of that window, if there is one."""
    r = rejected.withColumn("key", F.substring_index("region_id", ":", -1))
    rank = F.row_number().over(Window.partitionBy("win").orderBy("t0", "fact_id"))
    return r.join(instances, ["win", "key"], "left").select(F.concat(F.lit("D"), F.col("win").cast("string"), F.lit("-"), rank.cast("string")).alias("id"), "fact_id", "key", F.coalesce("seen", F.lit(0)).alias("seen"))
