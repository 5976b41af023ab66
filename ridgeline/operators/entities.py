"""Entities over role rows (fact_id, kind, predicate, t0, win, role, entity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aliases(roles: DataFrame) -> DataFrame:
    """A short alias for each entity: its prefix and its place by first sight, then id."""
    seen = roles.groupBy("entity").agg(F.min("t0").alias("first_seen"))
    prefix = F.substring("entity", 1, 1)
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("first_seen", "entity"))
    return seen.withColumn("prefix", prefix).select("entity", "first_seen", F.concat("prefix", rank.cast("string")).alias("alias"))


def profiles(roles: DataFrame) -> DataFrame:
    """Facts, windows, first and last sight of each entity."""
    return roles.groupBy("entity").agg(F.countDistinct("fact_id").alias("facts"), F.countDistinct("win").alias("windows"), F.min("t0").alias("first_seen"), F.max("t0").alias("last_seen"))


def top_predicates(roles: DataFrame, top: int = 15) -> DataFrame:
    """The commonest predicates of each entity; ties by first sight."""
    n = roles.groupBy("entity", "predicate").agg(F.count("*").alias("n"), F.min(F.struct("t0", "fact_id")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("n").desc(), "seen", "predicate"))
    return n.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("entity", "predicate", "n", "rank")


def majority_kind(roles: DataFrame) -> DataFrame:
    """The commonest kind of each entity; ties go to the kind seen first."""
    n = roles.groupBy("entity", "kind").agg(F.count("*").alias("n"), F.min(F.struct("t0", "fact_id")).alias("seen"))
    best = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("n").desc(), "seen"))
    return n.withColumn("_r", best).where("_r = 1").select("entity", "kind", "n")


def shared_windows(roles: DataFrame, a: str, b: str) -> DataFrame:
    """Windows in which both entities appear; null windows never count."""
    own = lambda e: roles.where((F.col("entity") == e) & F.col("win").isNotNull()).select("win").distinct()
    return own(a).intersect(own(b))


def repeated_roles(facts: DataFrame, least: int = 3) -> DataFrame:
    """Events whose roles stand in a window with at least three events and three predicates."""
    events = facts.where("kind = 'event'")
    key = Window.partitionBy("win", "agent", "object")
    out = events.withColumn("_n", F.count("*").over(key)).withColumn("_p", F.size(F.collect_set("predicate").over(key)))
    return out.where((F.col("_n") >= least) & (F.col("_p") >= least)).select("fact_id")
