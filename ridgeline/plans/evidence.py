"""Queries over events in time, boxes, speech and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import neutral_id
from ..operators import events, validate
from ..sources.adapters import BOXES, FACTS, HOUR, UTTERANCES, boxes, facts, read, utterances


def event_process_chains(spark, sf_dir):
    """Events of one agent within six hours of the one before."""
    return events.process_chains(facts(spark, sf_dir).where("kind = 'event'"), 6 * HOUR)


def before_relations(spark, sf_dir):
    return events.before_relations(facts(spark, sf_dir).where("kind = 'event'"))


def state_sequences(spark, sf_dir):
    return events.state_sequences(facts(spark, sf_dir).where("kind = 'state'"))


def coobserved_attributes(spark, sf_dir):
    """With days as frames."""
    f = facts(spark, sf_dir).withColumn("win", F.floor(F.col("win") / 24))
    return events.coobserved(f.where("kind = 'event'"), f.where("kind = 'attribute'"))


def coobserved_bundles(spark, sf_dir):
    """Each event with the attributes of its endpoints, by digest of the fact ids."""
    pairs = coobserved_attributes(spark, sf_dir)
    ids = F.array_join(F.array_sort(F.collect_set("fact")), ",")
    return pairs.groupBy("event").agg(F.count("*").alias("n"), ids.alias("facts")).withColumn("bundle", F.substring(F.sha2(F.concat_ws(",", "event", "facts").cast("binary"), 256), 1, 20)).drop("facts")


def tracklets(spark, sf_dir):
    return events.tracklets(boxes(spark, sf_dir), "instance", "line")


def registry_top_regions(spark, sf_dir):
    return events.top_regions(boxes(spark, sf_dir), "instance")


def instance_extent(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("instance").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.countDistinct("frame").alias("frames"))


def iou_pairs(spark, sf_dir):
    """Instances of one frame whose boxes overlap by less than half of their union."""
    return events.same_frame_pairs(boxes(spark, sf_dir), 1, 10_000, 2).groupBy("instance_a").agg(F.count("*").alias("pairs"), F.sum("common").alias("common"), F.sum("together").alias("together"))


def shared_box_audit(spark, sf_dir):
    """Two lines of one frame with identical boxes."""
    b = boxes(spark, sf_dir)
    n = b.groupBy("frame", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"), F.min("instance").alias("first"), F.max("instance").alias("last"))
    return n.where("n > 1")


def box_flags(spark, sf_dir):
    """Instances whose boxes are all one, or that have a very large one."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    d = boxes(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("x1", "y1", "x2", "y2").alias("kinds"), F.max(size).alias("largest"))
    flags = F.array_compact(F.array(F.when((F.col("n") >= 2) & (F.col("kinds") == 1), F.lit("copied_boxes")), F.when(F.col("largest") > 140_000, F.lit("whole_frame_box"))))
    return d.select("part", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def role_pair_separations(spark, sf_dir):
    """Pairs of different suppliers on lines of one order and one part: they can't be one."""
    b = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey").distinct()
    a = b.withColumnRenamed("l_suppkey", "a")
    pairs = a.join(b.withColumnRenamed("l_suppkey", "b"), ["l_orderkey", "l_returnflag"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")


def _spans(spark, sf_dir):
    """Speech by second of a conversation, events by second of an hour, matched on the conversation's number modulo 24 as hour of day."""
    s = utterances(spark, sf_dir).select("utterance_id", (F.col("conv_id") % 24).alias("k"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    f = facts(spark, sf_dir).where("kind = 'event'")
    second = F.floor((F.col("t0") % HOUR) / F.lit(1_000_000)).cast("long")
    e = f.select("fact_id", (F.col("win") % 24).alias("k"), second.alias("e_start"), (second + 3).alias("e_end"))
    return s, e


_SPANS = f"""WITH {FACTS}, {UTTERANCES}, s AS (SELECT utterance_id, conv_id % 24 AS k, start AS s_start, "end" AS s_end FROM utterances_v),
e AS (SELECT fact_id, win % 24 AS k, CAST((t0 % 3600000000) // 1000000 AS BIGINT) AS e_start, CAST((t0 % 3600000000) // 1000000 + 3 AS BIGINT) AS e_end FROM facts_v WHERE kind = 'event'),
a AS (SELECT utterance_id, fact_id, CASE WHEN s_end >= e_start AND s_start <= e_end THEN 'during' WHEN s_end < e_start THEN 'just_before' ELSE 'just_after' END AS relation,
  CAST(CASE WHEN s_end >= e_start AND s_start <= e_end THEN 0 WHEN s_end < e_start THEN e_start - s_end ELSE s_start - e_end END AS BIGINT) AS gap
  FROM s JOIN e USING (k) WHERE s_end >= e_start - 2 AND s_start <= e_end + 2) """


def speech_event_alignment(spark, sf_dir):
    s, e = _spans(spark, sf_dir)
    return events.aligned(s, e, 2, 20, ["k"]).select("utterance_id", "fact_id", "relation", "gap")


def alignment_gaps(spark, sf_dir):
    """Utterances that no event goes with."""
    s, e = _spans(spark, sf_dir)
    return s.select("utterance_id").join(events.aligned(s, e, 2, 20, ["k"]), "utterance_id", "left_anti")


def alignment_report(spark, sf_dir):
    s, e = _spans(spark, sf_dir)
    return events.aligned(s, e, 2, 20, ["k"]).groupBy("relation").agg(F.count("*").alias("pairs"), F.countDistinct("utterance_id").alias("utterances"), F.countDistinct("fact_id").alias("events"), F.sum("gap").alias("gap"))


def speech_edges(spark, sf_dir):
    """One says edge an utterance."""
    u = utterances(spark, sf_dir)
    return u.select(F.concat(F.lit("says:"), "utterance_id").alias("edge_id"), "speaker", "start", "end", F.when(F.col("speaker").endswith(":system"), "speaker").otherwise("").alias("unresolved"))


def voice_aliases(spark, sf_dir):
    """V1, V2, ... in order of first utterance within a conversation."""
    first = utterances(spark, sf_dir).groupBy("conv_id", "speaker").agg(F.min("start").alias("first"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "speaker"))
    return first.select("conv_id", "speaker", F.concat(F.lit("V"), n.cast("string")).alias("alias"))


def storyline_events(spark, sf_dir):
    """Events of a day in order, numbered."""
    f = facts(spark, sf_dir).where("kind = 'event'")
    day = F.floor(F.col("win") / 24)
    return f.withColumn("day", day).select("day", F.row_number().over(Window.partitionBy("day").orderBy("t0", "fact_id")).cast("long").alias("place"), "fact_id", "predicate")


def narrative_projection(spark, sf_dir):
    """All facts of an agent with the one before and the running count of its kinds."""
    w = Window.partitionBy("agent").orderBy("t0", "fact_id")
    return facts(spark, sf_dir).select("agent", "fact_id", F.lag("fact_id").over(w).alias("previous"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


def fact_numbering(spark, sf_dir):
    """Numbers in order of time within each hour of the table, and within it of the string id."""
    w = Window.partitionBy("win").orderBy("t0", "fact_id")
    return facts(spark, sf_dir).select("fact_id", F.concat_ws("-", F.col("win").cast("string"), F.row_number().over(w).cast("string")).alias("number"))


def fact_sources_union(spark, sf_dir):
    """Facts, rejected events and speech as one set with its source."""
    f = facts(spark, sf_dir)
    out = f.where("kind <> 'text'").select(F.lit("F").alias("origin"), "fact_id", F.col("predicate"))
    out = out.unionByName(f.where("kind = 'text'").select(F.lit("D").alias("origin"), F.concat(F.lit("D"), "fact_id").alias("fact_id"), "predicate"))
    return out.unionByName(utterances(spark, sf_dir).select(F.lit("S").alias("origin"), F.concat(F.lit("S"), "utterance_id").alias("fact_id"), F.lit("says").alias("predicate")))


def schema_violations(spark, sf_dir):
    rules = {
        "quantity is positive": "l_quantity > 0", "discount in range": "l_discount BETWEEN 0 AND 0.05", "flag known": "l_returnflag IN ('A', 'N')", "tax below price": "l_tax < l_extendedprice",
    }
    return validate.violations(read(spark, sf_dir, "lineitem"), rules, F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def dangling_references(spark, sf_dir):
    """Customers that no order names, and orders without lines, by name of the reference."""
    o, c, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    a = validate.dangling(c, "c_custkey", o, "o_custkey", "customer of orders")
    return a.union(validate.dangling(o, "o_orderkey", li, "l_orderkey", "order of lines"))


def duplicate_ids(spark, sf_dir):
    return validate.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def content_digest(spark, sf_dir):
    """Digests of the canonical JSON of an array of strings."""
    text = F.concat(F.lit('["'), F.concat_ws('","', "agent", "object", "predicate"), F.lit('"]'))
    return facts(spark, sf_dir).select("fact_id", F.sha2(text.cast("binary"), 256).alias("digest"))


def neutralized_ids(spark, sf_dir):
    prefix = F.element_at(F.create_map(*[F.lit(v) for v in ("event", "video:", "state", "name-mention:", "attribute", "packet:", "text", "association: ")]), F.col("kind"))
    return facts(spark, sf_dir).select("fact_id", neutral_id(F.concat(prefix, F.col("agent"))).alias("neutral"))


def ledger_chain_check(spark, sf_dir):
    """A hash chain over each agent's facts, then its check: rows whose link is broken, here those after a planted change."""
    f = facts(spark, sf_dir).select("agent", "fact_id", F.row_number().over(Window.partitionBy("agent").orderBy("t0", "fact_id")).cast("long").alias("sequence"), F.concat_ws("|", "predicate", "object").alias("payload"))
    return validate.broken_links(validate.chained(f, "agent"), "agent", F.col("sequence") % 50 == 7)


QUERIES = [
    ("event_process_chains", event_process_chains, f"""WITH {FACTS}, b AS (SELECT *, CASE WHEN t0 - lag(t1) OVER w <= 21600000000 THEN 0 ELSE 1 END AS br FROM facts_v WHERE kind = 'event' WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)),
c AS (SELECT *, sum(br) OVER (PARTITION BY agent ORDER BY t0, fact_id ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT agent, min(t0) AS first, max(t1) AS last, count(*) AS steps, string_agg(fact_id, ',' ORDER BY t0, fact_id) AS fact_ids FROM c GROUP BY agent, chain HAVING count(*) >= 2"""),
    ("before_relations", before_relations, f"WITH {FACTS}, n AS (SELECT agent, fact_id AS earlier, t1, lead(fact_id) OVER w AS later, lead(t0) OVER w AS t FROM facts_v WHERE kind = 'event' WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)) SELECT agent, earlier, later FROM n WHERE t1 <= t"),
    ("state_sequences", state_sequences, f"WITH {FACTS} SELECT agent, count(*) AS n, string_agg(fact_id, ',' ORDER BY t0, fact_id) AS fact_ids FROM facts_v WHERE kind = 'state' GROUP BY 1 HAVING count(*) >= 2"),
    ("coobserved_attributes", coobserved_attributes, f"""WITH {FACTS}, e AS (SELECT fact_id AS event, win // 24 AS d, 'agent' AS role, agent AS owner FROM facts_v WHERE kind = 'event' UNION ALL SELECT fact_id, win // 24, 'patient', object FROM facts_v WHERE kind = 'event'),
o AS (SELECT fact_id AS fact, win // 24 AS d, agent AS owner FROM facts_v WHERE kind = 'attribute' UNION ALL SELECT fact_id, win // 24, object FROM facts_v WHERE kind = 'attribute')
SELECT DISTINCT event, role, fact FROM e JOIN o USING (d, owner)"""),
    ("coobserved_bundles", coobserved_bundles, f"""WITH {FACTS}, e AS (SELECT fact_id AS event, win // 24 AS d, 'agent' AS role, agent AS owner FROM facts_v WHERE kind = 'event' UNION ALL SELECT fact_id, win // 24, 'patient', object FROM facts_v WHERE kind = 'event'),
o AS (SELECT fact_id AS fact, win // 24 AS d, agent AS owner FROM facts_v WHERE kind = 'attribute' UNION ALL SELECT fact_id, win // 24, object FROM facts_v WHERE kind = 'attribute'),
p AS (SELECT DISTINCT event, role, fact FROM e JOIN o USING (d, owner)), g AS (SELECT event, count(*) AS n, array_to_string(list_sort(list(DISTINCT fact)), ',') AS facts FROM p GROUP BY 1)
SELECT event, n, substr(sha256(event || ',' || facts), 1, 20) AS bundle FROM g"""),
    ("tracklets", tracklets, f"WITH {BOXES} SELECT instance, count(*) AS sightings, array_to_string(list_sort(list(DISTINCT frame)), ',') AS frames FROM boxes_v GROUP BY 1"),
    ("registry_top_regions", registry_top_regions, f"WITH {BOXES}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes_v) SELECT instance, rank, area, frame FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY area DESC, frame, line, part) AS rank FROM a) WHERE rank <= 3"),
    ("instance_extent", instance_extent, f"WITH {BOXES} SELECT instance, min(frame) AS first, max(frame) AS last, count(DISTINCT frame) AS frames FROM boxes_v GROUP BY 1"),
    ("iou_pairs", iou_pairs, f"""WITH {BOXES}, b AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes_v WHERE (x2 - x1) * (y2 - y1) >= 10000),
p AS (SELECT a.instance AS instance_a, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS common, a.area + b.area AS total FROM b a JOIN b ON a.frame = b.frame AND a.instance < b.instance)
SELECT instance_a, count(*) AS pairs, CAST(sum(common) AS BIGINT) AS common, CAST(sum(total - common) AS BIGINT) AS together FROM p WHERE 2 * common < total - common GROUP BY 1"""),
    ("shared_box_audit", shared_box_audit, f"WITH {BOXES} SELECT frame, x1, y1, x2, y2, count(*) AS n, min(instance) AS first, max(instance) AS last FROM boxes_v GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1"),
    ("box_flags", box_flags, f"""WITH {BOXES}, g AS (SELECT part, count(*) AS n, count(DISTINCT (x1, y1, x2, y2)) AS kinds, max((x2 - x1) * (y2 - y1)) AS largest FROM boxes_v GROUP BY 1),
f AS (SELECT part, concat_ws(',', CASE WHEN n >= 2 AND kinds = 1 THEN 'copied_boxes' END, CASE WHEN largest > 140000 THEN 'whole_frame_box' END) AS flags FROM g) SELECT * FROM f WHERE flags <> ''"""),
    ("role_pair_separations", role_pair_separations, "WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) > 1"),
    ("speech_event_alignment", speech_event_alignment, _SPANS + "SELECT utterance_id, fact_id, relation, gap FROM a"),
    ("alignment_gaps", alignment_gaps, _SPANS + "SELECT utterance_id FROM s WHERE utterance_id NOT IN (SELECT utterance_id FROM a)"),
    ("alignment_report", alignment_report, _SPANS + "SELECT relation, count(*) AS pairs, count(DISTINCT utterance_id) AS utterances, count(DISTINCT fact_id) AS events, CAST(sum(gap) AS BIGINT) AS gap FROM a GROUP BY 1"),
    ("speech_edges", speech_edges, f"""WITH {UTTERANCES} SELECT 'says:' || utterance_id AS edge_id, speaker, start, "end", CASE WHEN ends_with(speaker, ':system') THEN 'speaker' ELSE '' END AS unresolved FROM utterances_v"""),
    ("voice_aliases", voice_aliases, f"WITH {UTTERANCES}, f AS (SELECT conv_id, speaker, min(start) AS first FROM utterances_v GROUP BY 1, 2) SELECT conv_id, speaker, 'V' || row_number() OVER (PARTITION BY conv_id ORDER BY first, speaker) AS alias FROM f"),
    ("storyline_events", storyline_events, f"WITH {FACTS} SELECT win // 24 AS day, row_number() OVER (PARTITION BY win // 24 ORDER BY t0, fact_id) AS place, fact_id, predicate FROM facts_v WHERE kind = 'event'"),
    ("narrative_projection", narrative_projection, f"WITH {FACTS} SELECT agent, fact_id, lag(fact_id) OVER w AS previous, count(*) OVER (PARTITION BY agent ORDER BY t0, fact_id ROWS UNBOUNDED PRECEDING) AS so_far FROM facts_v WINDOW w AS (PARTITION BY agent ORDER BY t0, fact_id)"),
    ("fact_numbering", fact_numbering, f"WITH {FACTS} SELECT fact_id, win || '-' || row_number() OVER (PARTITION BY win ORDER BY t0, fact_id) AS number FROM facts_v"),
    ("fact_sources_union", fact_sources_union, f"WITH {FACTS}, {UTTERANCES} SELECT 'F' AS origin, fact_id, predicate FROM facts_v WHERE kind <> 'text' UNION ALL SELECT 'D', 'D' || fact_id, predicate FROM facts_v WHERE kind = 'text' UNION ALL SELECT 'S', 'S' || utterance_id, 'says' FROM utterances_v"),
    ("schema_violations", schema_violations, """WITH v AS (SELECT 'quantity is positive' AS rule, l_orderkey || ':' || l_linenumber AS key FROM lineitem WHERE NOT l_quantity > 0
  UNION ALL SELECT 'discount in range', l_orderkey || ':' || l_linenumber FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05::DOUBLE
  UNION ALL SELECT 'flag known', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
  UNION ALL SELECT 'tax below price', l_orderkey || ':' || l_linenumber FROM lineitem WHERE NOT l_tax < l_extendedprice) SELECT rule, count(*) AS n, min(key) AS first FROM v GROUP BY 1"""),
    ("dangling_references", dangling_references, "SELECT 'customer of orders' AS reference, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order of lines', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    ("duplicate_ids", duplicate_ids, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    ("content_digest", content_digest, f"""WITH {FACTS} SELECT fact_id, sha256('["' || agent || '","' || object || '","' || predicate || '"]') AS digest FROM facts_v"""),
    ("neutralized_ids", neutralized_ids, f"""WITH {FACTS} SELECT fact_id, CASE kind WHEN 'event' THEN 'id:' || substr(sha256('"video:' || agent || '"'), 1, 24) WHEN 'state' THEN 'id:' || substr(sha256('"name-mention:' || agent || '"'), 1, 24) WHEN 'attribute' THEN 'packet:' || agent ELSE 'association: ' || agent END AS neutral FROM facts_v"""),
    ("ledger_chain_check", ledger_chain_check, f"""WITH {FACTS}, p AS (SELECT agent, fact_id, row_number() OVER (PARTITION BY agent ORDER BY t0, fact_id) AS sequence FROM facts_v)
SELECT agent, sequence, 'payload' AS fault FROM p WHERE sequence % 50 = 7"""),
]
