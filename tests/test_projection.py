"""Handmade cases of the snapshot of links, left-out facts and names."""

from pyspark.sql import functions as F

from ridgeline.functions.text import normalize_name
from ridgeline.operators import events, projection, search

PROPOSALS = "proposal_id string, source string, target string, relation string, verdict string"
MEDIA = "proposal_id string, media string"
ANCHORS = "instance string, media string"
PAIRS = "left string, right string"
ALIASES = "media string, original string"


def shown(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("proposal_id", *columns).collect()}


def test_projected_links(spark):
    p = spark.createDataFrame([("a", "x", "y", "same_identity", "supported"), ("b", "x", "y", "continues", "supported"), ("c", "x", "z", "continues", "supported"), ("d", "x", "z", "part_of", "supported"), ("e", "x", "y", "same_identity", "contradicted"), ("f", "z", "w", "part_of", "supported"), (None, "x", None, None, None)], PROPOSALS)
    cites = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("b", None), ("c", "m1"), ("d", "m1"), (None, "m1")], MEDIA)
    anchors = spark.createDataFrame([("x", "m1"), ("x", "m1"), ("x", "m2"), (None, "m1")], ANCHORS)
    apart = spark.createDataFrame([("z", "x"), ("x", "z"), (None, "x")], PAIRS)
    aliases = spark.createDataFrame([("r1", "m1"), ("r1", "m0"), (None, "m1")], ALIASES)
    got = shown(projection.projected(p, cites, anchors, apart, aliases), "relation", "verdict", "source_verdict", "endpoint_gap", "original_relation")
    bare, veto = "independent_person_anchor_missing", "whole_person_event_roles_cannot_collapse"
    assert got == {
        "a": ("same_identity", "supported", None, None, None), "b": ("same_identity", "unresolved", "supported", bare, "continues"), "c": ("same_identity", "unresolved", "supported", veto, "continues"),
        "d": ("part_of", "supported", None, None, None), "e": ("same_identity", "contradicted", None, None, None), "f": ("part_of", "supported", None, None, None), None: (None, None, None, None, None),
    }


def test_projected_links_of_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert projection.projected(none(PROPOSALS), none(MEDIA), none(ANCHORS), none(PAIRS), none(ALIASES)).count() == 0
    p = spark.createDataFrame([("a", "x", "y", "continues", "supported")], PROPOSALS)
    assert shown(projection.projected(p, none(MEDIA), none(ANCHORS), none(PAIRS), none(ALIASES)), "verdict", "endpoint_gap") == {"a": ("supported", None)}


def test_endpoint_gaps(spark):
    roles = spark.createDataFrame([("f", "agent", "x"), ("f", "patient", "y"), ("g", "agent", "x"), ("g", "agent", "x"), ("h", None, None)], "fact_id string, role string, instance string")
    cites = spark.createDataFrame([("f", "agent", "m2"), ("g", "agent", "m9"), ("g", "patient", "m1")], "fact_id string, role string, media string")
    got = projection.endpoint_gaps(roles, cites, spark.createDataFrame([("x", "m1"), ("x", "m2")], ANCHORS)).collect()
    assert [tuple(r) for r in got] == [("g", "agent", "x", "person_roles_share_composite_box")]


def test_projected_owners(spark):
    e = spark.createDataFrame([("e1", 1, "p", "o", None), ("e2", 1, "p", "o", ["agent"])], "fact_id string, win int, agent string, object string, u array<string>")
    a = spark.createDataFrame([("s", 1, "region", None, ["p", "p"]), ("t", 2, "region", None, ["p"]), ("v", 1, "o", None, None)], "fact_id string, win int, agent string, object string, own array<string>")
    got = sorted(tuple(r) for r in events.coobserved(e, a, projected="own", unresolved="u").collect())
    assert got == [("e1", "agent", "s"), ("e1", "patient", "v"), ("e2", "patient", "v")]
    assert sorted(tuple(r) for r in events.coobserved(e, a).collect()) == [("e1", "patient", "v"), ("e2", "patient", "v")]


def test_left_out(spark):
    f = spark.createDataFrame([("F1", "event", None, None), ("F2", "event", True, None), ("F3", "event", True, True), ("F4", "state", True, False), ("F5", "event", False, True)], "fact_id string, kind string, dropped boolean, quarantined boolean")
    ids = lambda q, **k: sorted(r.fact_id for r in search.pool(f, q, **k).collect())
    q = search.Search(kinds=("event",))
    assert ids(q) == ["F1"] and ids(q, include_dropped=True) == ["F1", "F2"] and ids(search.Search(ids=("F2", "F3"))) == ["F2"]
    assert tuple(search.left_out(f, q).head()) == (1, 2) and tuple(search.left_out(f, search.Search(ids=("F2", "F3"))).head()) == (0, 1)


def test_normalized_names(spark):
    texts = ["  mary\t ann  o'NEIL-smith ", "x2y", "", None, "éMILE ΩMEGA", "李 ming"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.y for r in d.select("i", normalize_name(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [None if t is None else " ".join(t.split()).title() for t in texts]
