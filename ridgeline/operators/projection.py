"""What a snapshot makes of proposed links: anchors that must be cited, separations that veto, aliases of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uncited(ends: DataFrame, evidence: DataFrame, anchors: DataFrame, keys: list) -> DataFrame:
    """Ends (keys, instance) whose instance has anchors (instance, media) of which the evidence (keys, media) cites none.

    Anchors and evidence are rows, so all is joins on keys. Null instances have no anchors; null media cite nothing. Each end once.
    """
    ends = ends.select(*keys, "instance").distinct()
    anchored = ends.join(anchors.select("instance").distinct(), "instance", "left_semi")
    cited = anchored.join(evidence.select(*keys, "media").distinct(), keys).join(anchors.select("instance", "media").distinct(), ["instance", "media"], "left_semi")
    return anchored.join(cited.select(*keys, "instance"), [*keys, "instance"], "left_anti").select(*keys, "instance")


def substituted(evidence: DataFrame, aliases: DataFrame) -> DataFrame:
    """Evidence with the media that an alias (media, original) stands for in its place; of several originals, the largest."""
    one = aliases.groupBy("media").agg(F.max("original").alias("_original"))
    return evidence.join(one, "media", "left").withColumn("media", F.coalesce("_original", "media")).select(*evidence.columns)


def endpoint_gaps(roles: DataFrame, evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """Roles (fact_id, role, instance) whose instance has independent anchors, but none in the role's evidence (fact_id, role, media)."""
    return uncited(roles, evidence, anchors, ["fact_id", "role"]).withColumn("reason", F.lit("person_roles_share_composite_box"))


def projected(proposals: DataFrame, evidence: DataFrame, anchors: DataFrame, separations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Proposals (proposal_id, source, target, relation, verdict) as a snapshot shows them.

    In this order: a supported one with an anchored end whose anchors its evidence (proposal_id, media), aliases
    replaced, does not cite is unresolved; so is a supported identity inside a separated pair
    (left, right, in either order); continues becomes same_identity. Adds source_verdict, endpoint_gap and
    original_relation, null where nothing changed. proposal_id is unique, as in a journal; one that is null cites
    nothing and keeps its verdict unless it is separated. Empty tables: no rule applies.
    """
    ends = proposals.select("proposal_id", F.explode(F.array("source", "target")).alias("instance"))
    bare = uncited(ends, substituted(evidence, aliases), anchors, ["proposal_id"]).select("proposal_id", F.lit(True).alias("_bare")).distinct()
    apart = separations.select(F.least("left", "right").alias("_low"), F.greatest("left", "right").alias("_high"), F.lit(True).alias("_apart")).distinct()
    held = proposals.withColumn("_low", F.least("source", "target")).withColumn("_high", F.greatest("source", "target"))
    held = held.join(bare, "proposal_id", "left").join(apart, ["_low", "_high"], "left")
    supported = F.col("verdict") == "supported"
    vetoed = F.col("_apart") & F.col("relation").isin("same_identity", "continues")
    gap = F.when(supported & F.col("_bare"), "independent_person_anchor_missing").when(supported & vetoed, "whole_person_event_roles_cannot_collapse")
    continues = F.col("relation") == "continues"
    out = held.withColumn("endpoint_gap", gap)
    changed = F.col("endpoint_gap").isNotNull()
    return out.select(
        "proposal_id", "source", "target", F.when(continues, "same_identity").otherwise(F.col("relation")).alias("relation"), F.when(changed, "unresolved").otherwise(F.col("verdict")).alias("verdict"),
        F.when(changed, F.col("verdict")).alias("source_verdict"), "endpoint_gap", F.when(continues, F.col("relation")).alias("original_relation"),
    )
