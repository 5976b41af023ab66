"""Links between local sightings: admission, entities, journals, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components


def admitted(links: DataFrame) -> DataFrame:
    """Links with status. Components are those of supported links; a contradicted link
    within one disputes all links of that component; the rest are accepted or contradicted."""
    roots = components(links.where("verdict = 'supported'").select(F.col("source").alias("a"), F.col("target").alias("b")))
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    held = links.join(side("source"), "source", "left").join(side("target"), "target", "left")
    inside = F.when(F.col("_source") == F.col("_target"), F.col("_source"))
    held = held.withColumn("root", inside)
    bad = held.where("verdict = 'contradicted' AND root IS NOT NULL").select("root").distinct().withColumn("_bad", F.lit(True))
    held = held.join(bad, "root", "left")
    status = F.when(F.col("verdict") == "unresolved", "unresolved").when(F.col("_bad"), "disputed").when(F.col("verdict") == "contradicted", "contradicted").otherwise("accepted")
    return held.select("proposal_id", "source", "target", "verdict", "agent", status.alias("status"))


def entities(links: DataFrame) -> DataFrame:
    """Entities of at least two members over accepted links: root, members."""
    roots = components(links.where("status = 'accepted'").select(F.col("source").alias("a"), F.col("target").alias("b")))
    return roots.groupBy("root").agg(F.count("*").alias("members"), F.max("node").alias("last"))


def owner_conflicts(part_of: DataFrame) -> DataFrame:
    """part_of rows (source, owner) whose source has more than one owner are disputed."""
    w = Window.partitionBy("source")
    n = F.size(F.collect_set("owner").over(w))
    return part_of.withColumn("status", F.when(n > 1, "disputed").otherwise("accepted"))


def active_journal(journal: DataFrame) -> DataFrame:
    """Proposals that no later row revokes."""
    revoked = journal.where("operation = 'revoke'").select("proposal_id", F.col("revision").alias("_r"))
    proposed = journal.where("operation = 'propose'")
    return proposed.join(revoked, (proposed["proposal_id"] == revoked["proposal_id"]) & (F.col("_r") > F.col("revision")), "left_anti")


_DECISIONS = "agent string, revision long, proposal_id string, status string, reason string"


def fold_journal(proposals: DataFrame) -> DataFrame:
    """Decisions in order of revision, one fold per agent: agent, revision, proposal_id, source, target, relation.

    same: accepted unless an accepted different lies within the union of both
    groups. different: accepted, and retires the accepted same links of the
    group that both ends share. The fold depends on order, so it runs as one grouped function a key.
    """

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["revision", "proposal_id"])
        same: dict = {}
        different: list = []
        out: list = []

        def group(x):
            seen, todo = {x}, [x]
            while todo:
                at = todo.pop()
                for a, b in same.values():
                    for y in ((b,) if a == at else (a,) if b == at else ()):
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
            return seen

        status: dict = {}
        for r in pdf.itertuples():
            if r.relation == "same":
                both = group(r.source) | group(r.target)
                if any(a in both and b in both for a, b in different):
                    status[r.proposal_id] = ("deferred", "cluster_conflict")
                else:
                    same[r.proposal_id] = (r.source, r.target)
                    status[r.proposal_id] = ("accepted", "")
            else:
                shared = group(r.source)
                if r.target in shared:
                    for p in [p for p, (a, b) in same.items() if a in shared and b in shared]:
                        del same[p]
                        status[p] = ("revoked", "distinctness")
                different.append((r.source, r.target))
                status[r.proposal_id] = ("accepted", "")
        for r in pdf.itertuples():
            out.append((r.agent, r.revision, r.proposal_id, *status[r.proposal_id]))
        return pd.DataFrame(out, columns=["agent", "revision", "proposal_id", "status", "reason"])

    return proposals.groupBy("agent").applyInPandas(fold, _DECISIONS)


def witness_paths(links: DataFrame) -> DataFrame:
    """For each member, hops and nodes of the shortest path to the least member of its component (least neighbours first)."""

    def paths(pdf):
        import pandas as pd

        near: dict = {}
        for r in pdf.itertuples():
            near.setdefault(r.source, set()).add(r.target)
            near.setdefault(r.target, set()).add(r.source)
        out, left = [], set(near)
        while left:
            root = min(left)
            parent = {root: None}
            level = [root]
            while level:
                nxt = []
                for x in level:
                    for y in sorted(near[x]):
                        if y not in parent:
                            parent[y] = x
                            nxt.append(y)
                level = sorted(nxt)
            for x in parent:
                path = [x]
                while parent[path[-1]] is not None:
                    path.append(parent[path[-1]])
                out.append((pdf.agent.iloc[0], x, len(path) - 1, ">".join(path)))
            left -= set(parent)
        return pd.DataFrame(out, columns=["agent", "node", "hops", "path"])

    return links.select("agent", "source", "target").groupBy("agent").applyInPandas(paths, "agent string, node string, hops long, path string")
