"""Queries of scoped retrieval, facets, entities and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import dot
from ..functions.text import keyword_match, role_group
from ..operators import entities, search
from ..operators.search import Search
from ..sources import adapters
from ..sources.adapters import FACTS, ROLES, facts, read, roles

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01, in microseconds
BASE = START // 3_600_000_000

_COLUMNS = ["fact_id", "kind", "predicate", "agent", "object", "t0", "win", "multiplicity"]


def _found(spark, sf_dir, q: Search):
    return search.search(facts(spark, sf_dir, q), q).select(*_COLUMNS)


def _sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""WITH {FACTS}, c AS (
  SELECT *, count(*) OVER w AS multiplicity, row_number() OVER (PARTITION BY win, predicate, agent, object ORDER BY t0, fact_id) AS n
  FROM facts_v WHERE {where} WINDOW w AS (PARTITION BY win, predicate, agent, object))
SELECT {', '.join(_COLUMNS)} FROM c WHERE n = 1 ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


def search_keyword_time_page(spark, sf_dir):
    return _found(spark, sf_dir, Search(predicate="click|purchase", start=START + DAY, end=START + 20 * DAY, limit=10))


def search_kinds_window(spark, sf_dir):
    return _found(spark, sf_dir, Search(kinds=("state", "text"), windows=tuple(f"W{BASE + h}" for h in range(5, 60)), limit=100))


def search_ids(spark, sf_dir):
    return _found(spark, sf_dir, Search(ids=("f1", "F5", "F77", "F431", "F900000001"), limit=10))


def search_time_desc(spark, sf_dir):
    return _found(spark, sf_dir, Search(kinds=("attribute",), sort="time_desc", limit=25, offset=5))


def _with_roles(spark, sf_dir):
    def one(role, entity):
        return F.struct(F.lit(role).alias("role"), F.col(entity).alias("entity"), F.concat_ws(" ", F.lit("the"), "predicate", F.col(entity)).alias("description"))

    return facts(spark, sf_dir).withColumn("roles", F.array(one("agent", "agent"), one("patient", "object")))


def search_role_slots_actor_target(spark, sf_dir):
    q = Search(roles={"@actor": ["P1", "P2", "p3", "P4"], "@target": "?"})
    return _with_roles(spark, sf_dir).where(search.condition(q)).select("fact_id", "agent", "object")


def search_role_any(spark, sf_dir):
    return _with_roles(spark, sf_dir).where(search.condition(Search(roles={"*": "o7"}))).select("fact_id", "agent", "object")


def search_role_keywords(spark, sf_dir):
    return _with_roles(spark, sf_dir).where(search.condition(Search(roles={"patient": 'purch|view "o1"'}))).select("fact_id", "agent", "object")


def role_groups(spark, sf_dir):
    return roles(facts(spark, sf_dir)).groupBy(role_group(F.col("role")).alias("grp"), "kind").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


def search_phrase_or_terms(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(keyword_match(F.col("text"), '"general public"|licens rights|version|released')).select("doc_id", "source")


def search_cjk_substring(spark, sf_dir):
    held = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("红色汽车 "), "lang")).otherwise(F.col("lang")).alias("text"))
    return held.where(keyword_match(F.col("text"), "汽车 en|de")).select("doc_id", "text")


def search_period_segment(spark, sf_dir):
    """The middle third of a run of 30 days, cut with the second of three parts."""
    low, high = search.resolve_time(30 * 86400.0, period="middle_third", segment="2/3", start="96:00:00")
    return _found(spark, sf_dir, Search(kinds=("event",), start=START + int(low * 1e6), end=START + int(high * 1e6), limit=50))


def resolve_time_bounds(spark, sf_dir):
    """Bounds of named periods over the duration of the table, as columns of one aggregate."""
    d = facts(spark, sf_dir).agg(((F.max("t1") - F.min("t0")) / F.lit(1e6)).alias("duration"))
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for p, (a, b) in search.PERIODS.items()])
    return d.select("duration", F.inline(rows)).select("period", F.round(F.col("duration") * F.col("a"), 3).alias("low"), F.round(F.col("duration") * F.col("b"), 3).alias("high"))


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return search.similar(v, v.where("vec_id = 0"))


def search_vector_topk(spark, sf_dir):
    return _vectors(spark, sf_dir).orderBy(F.col("sim").desc(), "vec_id").limit(10).select("vec_id", F.round("sim", 5).alias("sim"))


def search_vector_relative_cut(spark, sf_dir):
    others = _vectors(spark, sf_dir).where("vec_id <> 0")
    return search.relative_cut(others).select("vec_id", "label")


def dedup_within_window(spark, sf_dir):
    return search.deduplicated(facts(spark, sf_dir), search.fact_key()[:3], ["t0", "fact_id"]).select("fact_id", "win", "predicate", "agent", "multiplicity")


def facet_anchors(spark, sf_dir):
    return search.facets(facts(spark, sf_dir))


def facet_grouping_sets(spark, sf_dir):
    return facts(spark, sf_dir).cube("kind", "predicate").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("predicate", F.lit("*")).alias("predicate"), "n")


def empty_windows(spark, sf_dir):
    """Hours of the first ten days without a purchase by one of the first users."""
    hours = spark.range(BASE, BASE + 24 * 31).select(F.col("id").alias("win"), (F.col("id") * adapters.HOUR).alias("start"), ((F.col("id") + 1) * adapters.HOUR).alias("end"))
    few = facts(spark, sf_dir).where("predicate = 'purchase' AND agent IN ('P1', 'P2', 'P3', 'P4', 'P5')")
    return search.empty_windows(hours, few, START, START + 10 * DAY).select("win", "start")


def entity_aliases(spark, sf_dir):
    return entities.aliases(roles(facts(spark, sf_dir)))


def entity_profile(spark, sf_dir):
    return entities.profiles(roles(facts(spark, sf_dir)))


def entity_top_predicates(spark, sf_dir):
    return entities.top_predicates(roles(facts(spark, sf_dir)), 3)


def entity_kind_majority(spark, sf_dir):
    return entities.majority_kind(roles(facts(spark, sf_dir)))


def entity_compare(spark, sf_dir):
    return entities.shared_windows(roles(facts(spark, sf_dir)), "P1", "O2")


def window_records(spark, sf_dir):
    """Records of all windows, in order within each."""
    from pyspark.sql import Window

    return facts(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy("t0", "fact_id")).cast("long")).select("win", "rank", "fact_id", "kind")


def _hits(spark, sf_dir):
    return facts(spark, sf_dir).where("kind = 'event' AND agent IN ('P3', 'P11', 'P40')")


def expand_window(spark, sf_dir):
    return search.expanded(facts(spark, sf_dir), _hits(spark, sf_dir), "window")


def expand_participants(spark, sf_dir):
    return search.expanded(facts(spark, sf_dir), _hits(spark, sf_dir), "participants")


def expand_closure(spark, sf_dir):
    return search.expanded(facts(spark, sf_dir), _hits(spark, sf_dir), "closure")


def _expand_sql(extra: str) -> str:
    return f"""WITH {FACTS}, h AS (SELECT fact_id AS hit, win, agent AS a, object AS o FROM facts_v WHERE kind = 'event' AND agent IN ('P3', 'P11', 'P40')),
r AS (SELECT hit, fact_id, row_number() OVER (PARTITION BY hit ORDER BY t0, fact_id) AS rank FROM facts_v JOIN h USING (win) WHERE fact_id <> hit {extra})
SELECT hit, fact_id, rank FROM r WHERE rank <= 12"""


def role_repetition_flag(spark, sf_dir):
    """Over windows of ten days, so that signatures repeat."""
    coarse = facts(spark, sf_dir).withColumn("win", F.floor(F.col("win") / 240)).withColumn("kind", F.lit("event"))
    return entities.repeated_roles(coarse, 2)


def video_card(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("agents"), F.max(F.coalesce("t1", F.lit(0))).alias("duration"))


def embedding_norms(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


_SIM = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS sim FROM embeddings, q) "

QUERIES = [
    ("search_keyword_time_page", search_keyword_time_page, _sql(f"regexp_matches(predicate, '^(click|purchase)') AND t1 >= {START + DAY} AND t0 <= {START + 20 * DAY}", "t0, fact_id", 10)),
    ("search_kinds_window", search_kinds_window, _sql(f"kind IN ('state', 'text') AND win BETWEEN {BASE + 5} AND {BASE + 59}", "t0, fact_id", 100)),
    ("search_ids", search_ids, _sql("fact_id IN ('F1', 'F5', 'F77', 'F431')", "t0, fact_id", 10)),
    ("search_time_desc", search_time_desc, _sql("kind = 'attribute'", "t0 DESC, fact_id", 25, 5)),
    ("search_role_slots_actor_target", search_role_slots_actor_target, f"WITH {FACTS} SELECT fact_id, agent, object FROM facts_v WHERE agent IN ('P1', 'P2', 'P3', 'P4')"),
    ("search_role_any", search_role_any, f"WITH {FACTS} SELECT fact_id, agent, object FROM facts_v WHERE object = 'O7'"),
    ("search_role_keywords", search_role_keywords, f"WITH {FACTS} SELECT fact_id, agent, object FROM facts_v WHERE predicate IN ('purchase', 'view') AND object LIKE 'O1%'"),
    ("role_groups", role_groups, f"WITH {FACTS}, {ROLES} SELECT CASE role WHEN 'agent' THEN '@actor' ELSE '@target' END AS grp, kind, count(*) AS n, count(DISTINCT entity) AS entities FROM roles_v GROUP BY 1, 2"),
    ("search_phrase_or_terms", search_phrase_or_terms, "SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])general\\s+public') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])licens') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(rights|version|released)')"),
    ("search_cjk_substring", search_cjk_substring, "SELECT doc_id, '红色汽车 ' || lang AS text FROM documents WHERE doc_id % 7 = 0 AND regexp_matches(lang, '^(en|de)')"),
    ("search_period_segment", search_period_segment, _sql(f"kind = 'event' AND t1 >= {START + int(10 * 86400 * 1e6)} AND t0 <= {START + int(20 * 86400 * 1e6)}", "t0, fact_id", 50)),
    ("resolve_time_bounds", resolve_time_bounds, f"WITH {FACTS}, d AS (SELECT (max(t1) - min(t0)) / 1e6::DOUBLE AS duration FROM facts_v), p(period, a, b) AS (VALUES ('beginning', 0::DOUBLE, 0.1::DOUBLE), ('end', 0.9, 1), ('first_half', 0, 0.5), ('second_half', 0.5, 1), ('first_third', 0, 1::DOUBLE / 3), ('middle_third', 1::DOUBLE / 3, 2::DOUBLE / 3), ('last_third', 2::DOUBLE / 3, 1), ('first_quarter', 0, 0.25), ('second_quarter', 0.25, 0.5), ('third_quarter', 0.5, 0.75), ('last_quarter', 0.75, 1)) SELECT period, round(duration * a, 3) AS low, round(duration * b, 3) AS high FROM d, p"),
    ("search_vector_topk", search_vector_topk, _SIM + "SELECT vec_id, round(sim, 5) AS sim FROM s ORDER BY s.sim DESC, vec_id LIMIT 10"),
    ("search_vector_relative_cut", search_vector_relative_cut, _SIM + "SELECT vec_id, label FROM s WHERE vec_id <> 0 AND sim >= (SELECT max(sim) FROM s WHERE vec_id <> 0) - 0.15"),
    ("dedup_within_window", dedup_within_window, f"WITH {FACTS} SELECT fact_id, win, predicate, agent, multiplicity FROM (SELECT *, count(*) OVER (PARTITION BY win, predicate, agent) AS multiplicity, row_number() OVER (PARTITION BY win, predicate, agent ORDER BY t0, fact_id) AS n FROM facts_v) WHERE n = 1"),
    ("facet_anchors", facet_anchors, f"""WITH {FACTS}, i AS (
  SELECT 'entity' AS facet, agent AS item, t0, fact_id FROM facts_v UNION ALL SELECT 'entity', object, t0, fact_id FROM facts_v
  UNION ALL SELECT 'predicate', predicate, t0, fact_id FROM facts_v WHERE kind = 'event' UNION ALL SELECT 'role', 'agent', t0, fact_id FROM facts_v
  UNION ALL SELECT 'role', 'patient', t0, fact_id FROM facts_v UNION ALL SELECT 'window', 'W' || win, t0, fact_id FROM facts_v),
g AS (SELECT facet, item, count(*) AS n, min(struct_pack(t := t0, f := fact_id)) AS seen FROM i GROUP BY 1, 2)
SELECT facet, item, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, seen, item) AS rank FROM g) WHERE rank <= 8"""),
    ("facet_grouping_sets", facet_grouping_sets, f"WITH {FACTS} SELECT coalesce(kind, '*') AS kind, coalesce(predicate, '*') AS predicate, count(*) AS n FROM facts_v GROUP BY CUBE (kind, predicate)"),
    ("empty_windows", empty_windows, f"WITH {FACTS} SELECT CAST(win AS BIGINT) AS win, CAST(win * 3600000000 AS BIGINT) AS start FROM range({BASE}, {BASE + 240}) r(win) WHERE win NOT IN (SELECT win FROM facts_v WHERE predicate = 'purchase' AND agent IN ('P1', 'P2', 'P3', 'P4', 'P5'))"),
    ("entity_aliases", entity_aliases, f"WITH {FACTS}, {ROLES}, s AS (SELECT entity, min(t0) AS first_seen FROM roles_v GROUP BY 1) SELECT entity, first_seen, entity[1] || row_number() OVER (PARTITION BY entity[1] ORDER BY first_seen, entity) AS alias FROM s"),
    ("entity_profile", entity_profile, f"WITH {FACTS}, {ROLES} SELECT entity, count(DISTINCT fact_id) AS facts, count(DISTINCT win) AS windows, min(t0) AS first_seen, max(t0) AS last_seen FROM roles_v GROUP BY 1"),
    ("entity_top_predicates", entity_top_predicates, f"WITH {FACTS}, {ROLES}, g AS (SELECT entity, predicate, count(*) AS n, min(struct_pack(t := t0, f := fact_id)) AS seen FROM roles_v GROUP BY 1, 2) SELECT entity, predicate, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, seen, predicate) AS rank FROM g) WHERE rank <= 3"),
    ("entity_kind_majority", entity_kind_majority, f"WITH {FACTS}, {ROLES}, g AS (SELECT entity, kind, count(*) AS n, min(struct_pack(t := t0, f := fact_id)) AS seen FROM roles_v GROUP BY 1, 2) SELECT entity, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, seen) AS rank FROM g) WHERE rank = 1"),
    ("entity_compare", entity_compare, f"WITH {FACTS}, {ROLES} SELECT win FROM roles_v WHERE entity = 'P1' INTERSECT SELECT win FROM roles_v WHERE entity = 'O2'"),
    ("window_records", window_records, f"WITH {FACTS} SELECT win, row_number() OVER (PARTITION BY win ORDER BY t0, fact_id) AS rank, fact_id, kind FROM facts_v"),
    ("expand_window", expand_window, _expand_sql("")),
    ("expand_participants", expand_participants, _expand_sql("AND (agent = a OR object = o)")),
    ("expand_closure", expand_closure, _expand_sql("AND (agent = a OR object = o) AND kind IN ('text', 'state', 'attribute')")),
    ("role_repetition_flag", role_repetition_flag, f"WITH {FACTS}, c AS (SELECT fact_id, predicate, agent, object, win // 240 AS w FROM facts_v), g AS (SELECT w, agent, object FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT predicate) >= 2) SELECT fact_id FROM c JOIN g USING (w, agent, object)"),
    ("video_card", video_card, f"WITH {FACTS} SELECT kind, count(*) AS n, count(DISTINCT agent) AS agents, max(coalesce(t1, 0)) AS duration FROM facts_v GROUP BY 1"),
    ("embedding_norms", embedding_norms, "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm FROM embeddings"),
]
