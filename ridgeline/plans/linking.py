"""Queries over identity links, journals and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import identity
from ..sources.adapters import FACTS, HOUR, LINKS, facts, links

DAY = 24 * HOUR


def _links(spark, sf_dir):
    return links(facts(spark, sf_dir))


def link_admission(spark, sf_dir):
    return identity.admitted(_links(spark, sf_dir)).select("proposal_id", "status")


def link_disputes(spark, sf_dir):
    """Links between every other day: components with a contradiction inside are disputed whole."""
    held = _links(spark, sf_dir)
    w = Window.partitionBy("agent").orderBy("source")
    skip = held.withColumn("target", F.lead("target").over(w)).where("target IS NOT NULL").withColumn("proposal_id", F.concat(F.lit("x"), "proposal_id")).withColumn("verdict", F.lit("contradicted"))
    some = skip.where(F.crc32(F.col("agent").cast("binary")) % 3 == 0)
    return identity.admitted(held.unionByName(some)).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("agents"))


def connected_entities(spark, sf_dir):
    return identity.entities(identity.admitted(_links(spark, sf_dir)))


def owner_conflicts(spark, sf_dir):
    """Each object of a day belongs to the agents that touched it."""
    f = facts(spark, sf_dir).where("kind = 'state'")
    part_of = f.select(F.concat_ws("@", "object", F.floor(F.col("t0") / F.lit(DAY)).cast("string")).alias("source"), F.col("agent").alias("owner")).distinct()
    return identity.owner_conflicts(part_of)


def _journal(spark, sf_dir):
    """Every event of a user as a row: errors revoke the row before them, others propose."""
    w = Window.partitionBy("agent").orderBy("t0", "fact_id")
    f = facts(spark, sf_dir).withColumn("revision", F.row_number().over(w).cast("long")).withColumn("before", F.lag("fact_id").over(w))
    revoke = (F.col("predicate") == "error") & F.col("before").isNotNull()
    return f.select("agent", "revision", F.when(revoke, "revoke").otherwise("propose").alias("operation"), F.when(revoke, F.col("before")).otherwise(F.col("fact_id")).alias("proposal_id"))


_JOURNAL = f"""WITH {FACTS}, n AS (SELECT *, row_number() OVER w AS revision, lag(fact_id) OVER w AS before FROM facts_v WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)),
j AS (SELECT agent, revision, CASE WHEN predicate = 'error' AND before IS NOT NULL THEN 'revoke' ELSE 'propose' END AS operation, CASE WHEN predicate = 'error' AND before IS NOT NULL THEN before ELSE fact_id END AS proposal_id FROM n) """


def active_journal(spark, sf_dir):
    return identity.active_journal(_journal(spark, sf_dir)).select("agent", "proposal_id")


def journal_gapless_check(spark, sf_dir):
    return _journal(spark, sf_dir).where("operation = 'propose'").groupBy("agent").agg(F.max("revision").alias("last"), (F.max("revision") - F.count("*")).alias("missing"))


def identity_journal(spark, sf_dir):
    held = _links(spark, sf_dir)
    w = Window.partitionBy("agent").orderBy("source")
    relation = F.when(F.col("verdict") == "contradicted", "different").otherwise("same")
    return identity.fold_journal(held.select("agent", F.row_number().over(w).cast("long").alias("revision"), "proposal_id", "source", "target", relation.alias("relation")))


def identity_paths(spark, sf_dir):
    return identity.witness_paths(_links(spark, sf_dir).where("verdict = 'supported'"))


def binding_admission_status(spark, sf_dir):
    """Candidates of a day and object: several distinct agents conflict, errors revoke."""
    f = facts(spark, sf_dir).withColumn("key", F.concat_ws("@", "object", F.floor(F.col("t0") / F.lit(DAY)).cast("string")))
    n = F.size(F.collect_set("agent").over(Window.partitionBy("key")))
    status = F.when(F.col("kind") == "text", "revoked").when(n > 1, "conflict").when(F.col("kind") == "event", "accepted").otherwise("unresolved")
    return f.select("fact_id", status.alias("status"))


def registry_status(spark, sf_dir):
    """Accepted links with both ends in one entity, by entity."""
    held = identity.admitted(_links(spark, sf_dir)).where("status = 'accepted'")
    roots = identity.components(held.select(F.col("source").alias("a"), F.col("target").alias("b")))
    both = held.join(roots.withColumnRenamed("node", "source"), "source").groupBy("root").agg(F.count("*").alias("links"))
    return both.withColumn("status", F.when(F.col("links") > 1, "linked_candidate").otherwise("unresolved_local"))


def owner_projection(spark, sf_dir):
    """Objects of a day with exactly one agent, with it."""
    f = facts(spark, sf_dir).select(F.concat_ws("@", "object", F.floor(F.col("t0") / F.lit(DAY)).cast("string")).alias("region"), "agent")
    return f.groupBy("region").agg(F.min("agent").alias("owner"), F.countDistinct("agent").alias("n")).where("n = 1").select("region", "owner")


def support_dimensions(spark, sf_dir):
    """How events are supported: an owner seen that hour, an object seen elsewhere that hour, both."""
    f = facts(spark, sf_dir)
    owners = f.where("kind <> 'event'").select("win", "agent").distinct().withColumn("owner_seen", F.lit(True))
    objects = f.where("kind <> 'event'").select("win", "object").distinct().withColumn("object_seen", F.lit(True))
    d = f.where("kind = 'event'").join(owners, ["win", "agent"], "left").join(objects, ["win", "object"], "left")
    a, b = F.coalesce("owner_seen", F.lit(False)), F.coalesce("object_seen", F.lit(False))
    return d.select("fact_id", a.alias("owner_seen"), b.alias("object_seen"), (a & b).alias("joint"))


def evidence_frames(spark, sf_dir):
    """All hours in which a day's agent was seen, joint and by kind, as one set."""
    d = facts(spark, sf_dir).groupBy("agent", F.floor(F.col("win") / 24).alias("day")).agg(F.collect_set(F.when(F.col("kind") == "event", F.col("win"))).alias("joint"), F.collect_set(F.when(F.col("kind") != "event", F.col("win"))).alias("slots"))
    frames = F.array_sort(F.array_union("joint", "slots"))
    return d.select("agent", "day", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"), F.size(F.array_intersect("joint", "slots")).cast("long").alias("both"))


def identity_evidence_links(spark, sf_dir):
    """Both directions of every link, supported ones as same."""
    held = _links(spark, sf_dir).withColumn("relation", F.when(F.col("verdict") == "supported", "same").otherwise("different"))
    return held.select(F.col("source").alias("entity"), F.col("target").alias("other"), "relation").union(held.select("target", "source", "relation"))


def text_revision_latest(spark, sf_dir):
    """The latest value of each agent's error rows, its version, and the one it replaced."""
    w = Window.partitionBy("agent").orderBy("t0", "fact_id")
    f = facts(spark, sf_dir).where("kind = 'text'").withColumn("version", (F.row_number().over(w) + 1).cast("long")).withColumn("previous", F.lag("object").over(w))
    last = F.row_number().over(Window.partitionBy("agent").orderBy(F.col("version").desc()))
    return f.withColumn("_r", last).where("_r = 1").select("agent", "version", "previous", F.col("object").alias("value"))


def admission_manifest(spark, sf_dir):
    """Counts by agent of what was committed and lost, and whether to look again."""
    k = F.col("kind")
    return facts(spark, sf_dir).groupBy("agent").agg(F.sum(F.when(k == "event", 1).otherwise(0)).alias("events"), F.sum(F.when(k == "state", 1).otherwise(0)).alias("states"), F.sum(F.when(k == "text", 1).otherwise(0)).alias("losses"), F.bool_or(F.col("value") > 300).alias("look_again"))


_COMPONENTS = """adj AS (SELECT source AS a, target AS b, agent FROM {0} UNION ALL SELECT target, source, agent FROM {0}),
reach(node, other) AS (SELECT a, a FROM adj UNION SELECT r.node, adj.b FROM reach r JOIN adj ON r.other = adj.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""
_ADMITTED = f"WITH RECURSIVE {FACTS}, {LINKS}, sup AS (SELECT * FROM links_v WHERE verdict = 'supported'), {_COMPONENTS.format('sup')}, "
_STATUS = """h AS (SELECT l.*, CASE WHEN s.root = t.root THEN s.root END AS root FROM links_v l LEFT JOIN roots s ON l.source = s.node LEFT JOIN roots t ON l.target = t.node),
bad AS (SELECT DISTINCT root FROM h WHERE verdict = 'contradicted' AND root IS NOT NULL),
adm AS (SELECT h.*, CASE WHEN bad.root IS NOT NULL THEN 'disputed' WHEN verdict = 'contradicted' THEN 'contradicted' ELSE 'accepted' END AS status FROM h LEFT JOIN bad ON h.root = bad.root)"""

QUERIES = [
    ("link_admission", link_admission, _ADMITTED + _STATUS + " SELECT proposal_id, status FROM adm"),
    ("link_disputes", link_disputes, None),
    ("connected_entities", connected_entities, _ADMITTED + _STATUS + " SELECT root, count(*) AS members, max(node) AS last FROM roots GROUP BY 1"),
    ("owner_conflicts", owner_conflicts, f"WITH {FACTS}, p AS (SELECT DISTINCT object || '@' || (t0 // 86400000000) AS source, agent AS owner FROM facts_v WHERE kind = 'state') SELECT source, owner, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN 'disputed' ELSE 'accepted' END AS status FROM p"),
    ("active_journal", active_journal, _JOURNAL + "SELECT agent, proposal_id FROM j p WHERE operation = 'propose' AND NOT EXISTS (SELECT 1 FROM j r WHERE r.operation = 'revoke' AND r.proposal_id = p.proposal_id AND r.revision > p.revision)"),
    ("journal_gapless_check", journal_gapless_check, _JOURNAL + "SELECT agent, max(revision) AS last, max(revision) - count(*) AS missing FROM j WHERE operation = 'propose' GROUP BY 1"),
    ("identity_journal", identity_journal, None),
    ("identity_paths", identity_paths, None),
    ("binding_admission_status", binding_admission_status, f"WITH {FACTS}, k AS (SELECT *, object || '@' || (t0 // 86400000000) AS key FROM facts_v), n AS (SELECT key, count(DISTINCT agent) AS n FROM k GROUP BY 1) SELECT fact_id, CASE WHEN kind = 'text' THEN 'revoked' WHEN n > 1 THEN 'conflict' WHEN kind = 'event' THEN 'accepted' ELSE 'unresolved' END AS status FROM k JOIN n USING (key)"),
    ("registry_status", registry_status, _ADMITTED + _STATUS + " SELECT r.root AS root, count(*) AS links, CASE WHEN count(*) > 1 THEN 'linked_candidate' ELSE 'unresolved_local' END AS status FROM adm JOIN roots r ON adm.source = r.node WHERE status = 'accepted' GROUP BY 1"),
    ("owner_projection", owner_projection, f"WITH {FACTS} SELECT object || '@' || (t0 // 86400000000) AS region, min(agent) AS owner FROM facts_v GROUP BY 1 HAVING count(DISTINCT agent) = 1"),
    ("support_dimensions", support_dimensions, f"WITH {FACTS}, s AS (SELECT * FROM facts_v WHERE kind <> 'event'), e AS (SELECT fact_id, EXISTS (SELECT 1 FROM s WHERE s.win = f.win AND s.agent = f.agent) AS owner_seen, EXISTS (SELECT 1 FROM s WHERE s.win = f.win AND s.object = f.object) AS object_seen FROM facts_v f WHERE kind = 'event') SELECT *, owner_seen AND object_seen AS joint FROM e"),
    ("evidence_frames", evidence_frames, f"""WITH {FACTS}, g AS (SELECT agent, win // 24 AS day, win, bool_or(kind = 'event') AS j, bool_or(kind <> 'event') AS s FROM facts_v GROUP BY 1, 2, 3)
SELECT agent, day, array_to_string(list_sort(list(win)), ',') AS frames, count(*) FILTER (j AND s) AS both FROM g GROUP BY 1, 2"""),
    ("identity_evidence_links", identity_evidence_links, f"WITH {FACTS}, {LINKS}, r AS (SELECT source, target, CASE WHEN verdict = 'supported' THEN 'same' ELSE 'different' END AS relation FROM links_v) SELECT source AS entity, target AS other, relation FROM r UNION ALL SELECT target, source, relation FROM r"),
    ("text_revision_latest", text_revision_latest, f"WITH {FACTS}, v AS (SELECT agent, row_number() OVER w + 1 AS version, lag(object) OVER w AS previous, object AS value, row_number() OVER (PARTITION BY agent ORDER BY t0 DESC, fact_id DESC) AS r FROM facts_v WHERE kind = 'text' WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)) SELECT agent, version, previous, value FROM v WHERE r = 1"),
    ("admission_manifest", admission_manifest, f"WITH {FACTS} SELECT agent, count(*) FILTER (kind = 'event') AS events, count(*) FILTER (kind = 'state') AS states, count(*) FILTER (kind = 'text') AS losses, bool_or(value > 300) AS look_again FROM facts_v GROUP BY 1"),
]
