"""Queries of reviews, audits, flags and derived edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reviews
from ..sources.adapters import FACTS, HOUR, UTTERANCES, facts, utterances


def jersey_event_link(spark, sf_dir):
    """Attributes of an agent with the events of that agent within six hours."""
    f = facts(spark, sf_dir)
    a = f.where("kind = 'attribute'").select("agent", F.col("fact_id").alias("attribute"), F.col("t0").alias("t_left"))
    e = f.where("kind = 'event'").select("agent", F.col("fact_id").alias("event"), F.col("t0").alias("t_right"))
    near = reviews.near_in_time(a, e, ["agent"], 6 * HOUR)
    return near.groupBy("attribute").agg(F.count("*").alias("n"), F.min("event").alias("first"), F.max("event").alias("last"))


def name_jersey_candidates(spark, sf_dir):
    """States as mentions of an object, attributes as jerseys, purchases of the object that day as aligned events."""
    f = facts(spark, sf_dir)
    m = f.where("kind = 'state'").select("object", F.col("fact_id").alias("mention"), F.col("t0").alias("t_left"), F.floor(F.col("win") / 24).alias("day"))
    j = f.where("kind = 'attribute'").select("object", F.col("fact_id").alias("jersey"), F.col("t0").alias("t_right"))
    n = f.where("predicate = 'purchase'").groupBy("object", F.floor(F.col("win") / 24).alias("day")).agg(F.count("*").alias("events"))
    return reviews.nearby_status(m.join(n, ["object", "day"], "left"), j, ["object"], 48 * HOUR, "mention", "jersey", "events")


def review_gates(spark, sf_dir):
    """Objects of a day: seen by click and view, and no error."""
    f = facts(spark, sf_dir).withColumn("day", F.floor(F.col("win") / 24))
    return reviews.gate(f, ["object", "day"], "predicate", ("click", "view"), F.col("kind") == "text")


def replacement_links(spark, sf_dir):
    return reviews.replacement_links(facts(spark, sf_dir), "view", "purchase", ["agent"])


def rejected_event_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    rejected = f.where("kind = 'text'").withColumn("region_id", F.concat_ws(":", F.lit("obs"), F.col("win").cast("string"), "object"))
    seen = f.where("kind <> 'text'").groupBy("win", F.col("object").alias("key")).agg(F.count("*").alias("seen"))
    return reviews.rejected_facts(rejected, seen)


def audit_flags(spark, sf_dir):
    """Facts named by one of two audits: agents with a very large value, and objects of errors by one user."""
    f = facts(spark, sf_dir)
    a = f.where("value > 400").select("fact_id")
    b = f.where("kind = 'text' AND agent = 'P7'").select("fact_id")
    return f.select("fact_id", "kind").join(a.union(b).distinct(), "fact_id", "left_semi")


def reliability_flags(spark, sf_dir):
    """Flags of each fact: its window's only one of the agent, rejected, unresolved value, repeated pair in the hour."""
    once = F.count("*").over(Window.partitionBy("agent", F.floor(F.col("win") / 24)))
    pair = F.count("*").over(Window.partitionBy("win", "object"))
    f = facts(spark, sf_dir).withColumn("_o", once).withColumn("_p", pair)
    flags = F.array_compact(
        F.array(
            F.when(F.col("_o") == 1, F.lit("single_window_identity")), F.when(F.col("kind") == "text", F.lit("dropped_by_validator")),
            F.when(F.col("value") < 0.5, F.lit("unresolved_slots")), F.when(F.col("_p") > 1, F.lit("roles_repeated_in_window")),
        )
    )
    return f.select("fact_id", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def claim_edges(spark, sf_dir):
    """Each sentence of an utterance as a reported claim, never as a fact of the world."""
    u = utterances(spark, sf_dir)
    parts = F.filter(F.transform(F.split("text", "[.]"), lambda x: F.btrim(x, F.lit(" \n"))), lambda x: x != "")
    e = u.select("utterance_id", F.posexplode(parts).alias("n", "claim"))
    return e.select(F.concat_ws(":", "utterance_id", F.col("n").cast("string")).alias("claim_id"), F.md5(F.col("claim").cast("binary")).alias("digest"), F.lit(False).alias("world_fact"))


def reference_edges(spark, sf_dir):
    """Mentions of an object with exactly one agent that day: an edge with the agent's first fact as witness."""
    f = facts(spark, sf_dir).withColumn("day", F.floor(F.col("win") / 24))
    only = f.groupBy("object", "day").agg(F.min("agent").alias("owner"), F.countDistinct("agent").alias("n")).where("n = 1")
    witness = f.groupBy("agent").agg(F.min_by("fact_id", F.struct("t0", "fact_id")).alias("witness"))
    return f.where("kind = 'text'").join(only, ["object", "day"]).join(witness.withColumnRenamed("agent", "owner"), "owner").select("fact_id", "owner", "witness")


def window_containing(spark, sf_dir):
    """For each fact the first six-hour window of its agent's day that holds it: low <= t < high."""
    f = facts(spark, sf_dir)
    low = F.floor(F.col("t0") / F.lit(6 * HOUR)) * F.lit(6 * HOUR)
    return f.where("kind = 'event'").groupBy("agent", low.alias("low")).agg(F.count("*").alias("n"), F.min_by("fact_id", F.struct("t0", "fact_id")).alias("first"))


def submission_violations(spark, sf_dir):
    """Rows of a conversation that break a rule of submissions: no text, a turn out of order, an unknown role, a repeated id."""
    u = utterances(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = u.withColumn("_n", F.row_number().over(w) - 1).withColumn("_c", F.count("*").over(Window.partitionBy("utterance_id")))
    rule = F.array_compact(
        F.array(
            F.when(F.coalesce(F.char_length("text"), F.lit(0)) < 60, F.lit("text")), F.when(F.col("_n") != F.col("turn"), F.lit("order")),
            F.when(~F.col("speaker").rlike(":(user|assistant)$"), F.lit("role")), F.when(F.col("_c") > 1, F.lit("repeated")),
        )
    )
    return d.select("utterance_id", F.explode(rule).alias("rule")).distinct()


QUERIES = [
    ("jersey_event_link", jersey_event_link, f"WITH {FACTS} SELECT a.fact_id AS attribute, count(*) AS n, min(e.fact_id) AS first, max(e.fact_id) AS last FROM facts_v a JOIN facts_v e ON a.agent = e.agent AND abs(a.t0 - e.t0) <= 21600000000 WHERE a.kind = 'attribute' AND e.kind = 'event' GROUP BY 1"),
    ("name_jersey_candidates", name_jersey_candidates, f"""WITH {FACTS}, p AS (SELECT object, win // 24 AS day, count(*) AS events FROM facts_v WHERE predicate = 'purchase' GROUP BY 1, 2),
m AS (SELECT s.fact_id AS mention, s.object, s.t0, p.events FROM facts_v s LEFT JOIN p ON s.object = p.object AND s.win // 24 = p.day WHERE kind = 'state'),
g AS (SELECT mention, count(DISTINCT j.fact_id) AS n, max(events) AS e FROM m JOIN facts_v j ON m.object = j.object AND j.kind = 'attribute' AND abs(m.t0 - j.t0) <= 172800000000 GROUP BY 1)
SELECT mention, n AS nearby, CASE WHEN n = 1 AND e = 1 THEN 'accepted' WHEN n = 1 THEN 'provisional_unique' ELSE 'ambiguous' END AS status FROM g"""),
    ("review_gates", review_gates, f"WITH {FACTS}, g AS (SELECT object, win // 24 AS day, count(DISTINCT predicate) AS stages, bool_or(kind = 'text') AS denied, bool_or(predicate = 'click') AND bool_or(predicate = 'view') AS complete FROM facts_v GROUP BY 1, 2) SELECT object, day, stages, denied, complete AND NOT denied AS passed FROM g"),
    ("replacement_links", replacement_links, f"WITH {FACTS}, l AS (SELECT *, lag(predicate) OVER w AS p, lag(object) OVER w AS source FROM facts_v WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)) SELECT fact_id, source, object AS target, substr(sha256('replace|' || fact_id || '|' || source || '|' || object), 1, 20) AS proposal_id FROM l WHERE predicate = 'purchase' AND p = 'view' AND source <> object"),
    ("rejected_event_facts", rejected_event_facts, f"WITH {FACTS}, s AS (SELECT win, object AS key, count(*) AS seen FROM facts_v WHERE kind <> 'text' GROUP BY 1, 2) SELECT 'D' || f.win || '-' || row_number() OVER (PARTITION BY f.win ORDER BY t0, fact_id) AS id, fact_id, object AS key, coalesce(seen, 0) AS seen FROM facts_v f LEFT JOIN s ON f.win = s.win AND f.object = s.key WHERE kind = 'text'"),
    ("audit_flags", audit_flags, f"WITH {FACTS} SELECT fact_id, kind FROM facts_v WHERE value > 400 OR (kind = 'text' AND agent = 'P7')"),
    ("reliability_flags", reliability_flags, f"""WITH {FACTS}, c AS (SELECT *, count(*) OVER (PARTITION BY agent, win // 24) AS o, count(*) OVER (PARTITION BY win, object) AS p FROM facts_v),
f AS (SELECT fact_id, concat_ws(',', CASE WHEN o = 1 THEN 'single_window_identity' END, CASE WHEN kind = 'text' THEN 'dropped_by_validator' END, CASE WHEN value < 0.5 THEN 'unresolved_slots' END, CASE WHEN p > 1 THEN 'roles_repeated_in_window' END) AS flags FROM c) SELECT * FROM f WHERE flags <> ''"""),
    ("claim_edges", claim_edges, f"""WITH {UTTERANCES}, s AS (SELECT utterance_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS parts FROM utterances_v),
e AS (SELECT utterance_id, unnest(parts) AS claim, generate_subscripts(parts, 1) - 1 AS n FROM s) SELECT utterance_id || ':' || n AS claim_id, md5(claim) AS digest, false AS world_fact FROM e"""),
    ("reference_edges", reference_edges, f"""WITH {FACTS}, o AS (SELECT object, win // 24 AS day, min(agent) AS owner FROM facts_v GROUP BY 1, 2 HAVING count(DISTINCT agent) = 1),
w AS (SELECT agent, arg_min(fact_id, struct_pack(t := t0, f := fact_id)) AS witness FROM facts_v GROUP BY 1)
SELECT fact_id, owner, witness FROM facts_v f JOIN o ON f.object = o.object AND f.win // 24 = o.day JOIN w ON w.agent = o.owner WHERE kind = 'text'"""),
    ("window_containing", window_containing, f"WITH {FACTS} SELECT agent, t0 // 21600000000 * 21600000000 AS low, count(*) AS n, arg_min(fact_id, struct_pack(t := t0, f := fact_id)) AS first FROM facts_v WHERE kind = 'event' GROUP BY 1, 2"),
    ("submission_violations", submission_violations, f"""WITH {UTTERANCES}, d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY utterance_id) AS c FROM utterances_v)
SELECT utterance_id, 'text' AS rule FROM d WHERE coalesce(length(text), 0) < 60 UNION SELECT utterance_id, 'order' FROM d WHERE n <> turn UNION SELECT utterance_id, 'role' FROM d WHERE NOT regexp_matches(speaker, ':(user|assistant)$') UNION SELECT utterance_id, 'repeated' FROM d WHERE c > 1"""),
]
