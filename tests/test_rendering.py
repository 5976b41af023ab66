"""Handmade cases of rendering, cut texts, window views and name reviews."""

from pyspark.sql import functions as F

from ridgeline.functions.text import action_terms, cut_words
from ridgeline.operators import rendering

FACTS = "fact_id string, t0 double, t1 double, win int, kind string, carrier string, predicate string, value string, dropped boolean, reason string, flags array<string>, roles array<struct<role:string,entity:string,description:string>>"
ROWS = [
    ("F1", 61.5, 61.5, 2, "event", None, "passes", None, None, None, None, [("agent", "P1", "a tall man"), ("patient", "O1", None), ("giver", "P1", "a tall man")]),
    ("F2", 62.0, 125.0, 2, "text", "board", "reads", "7", True, "weak", ["b", "a"], [("agent", "P1", "a tall man"), ("x", None, "some thing"), ("y", "O1", "ball")]),
    ("F3", None, None, None, "state", "x", "is", "", False, None, [], None),
]


def test_lines(spark):
    got = [r.line for r in rendering.rendered(spark.createDataFrame(ROWS, FACTS), 6).orderBy("fact_id").collect()]
    assert got == ['F1 [1:01.5] W2 event "passes" | agent,giver=P1 "a…" ; patient=O1', 'F2 [1:02.0–2:05.0] W2 text(board) "reads" = "7" | agent=P1 "a…" ; x=? "some…" ; y=O1 "ball" | ⚠ a, b | reason=weak', 'F3 [?] state "is" | ']
    assert rendering.rendered(spark.createDataFrame([], FACTS)).count() == 0


def test_pages_describe_once(spark):
    got = [r.line for r in rendering.rendered_page(spark.createDataFrame(ROWS, FACTS), [F.col("t0").asc_nulls_last(), "fact_id"]).collect()]
    assert got[0].endswith('agent,giver=P1 "a tall man" ; patient=O1') and '| agent=P1 ; x=? "some thing" ; y=O1 |' in got[1] and got[2] == 'F3 [?] state "is" | '


def test_cut_and_terms(spark):
    d = spark.createDataFrame([(0, "one two three"), (1, "abcdefghij"), (2, None), (3, "a  b"), (4, "Caught, then passed; LOB dunk")], "i int, x string")
    rows = d.select("i", cut_words(F.col("x"), 7).alias("c"), cut_words(F.col("x"), 0).alias("none"), action_terms(F.col("x")).alias("a")).orderBy("i").collect()
    assert [r.c for r in rows] == ["one…", "abcdefg…", "", "a  b", "Caught,…"] and {r.none for r in rows} == {""}
    assert [r.a for r in rows] == [[], [], [], [], ["catch", "dunk", "pass"]]


def test_window_view(spark):
    f = spark.createDataFrame([("F1", 1), ("F2", 1), ("F3", 2), ("F4", 3), ("F5", None)], "fact_id string, win int")
    page = f.where("fact_id IN ('F2', 'F3', 'F4', 'F5')")
    assert sorted(tuple(r) for r in rendering.window_view(f, page, 2).collect()) == [("F1", 1, False), ("F2", 1, True), ("F3", 2, True)]


def test_name_reviews(spark):
    m = spark.createDataFrame([(k, "d", "p", ["m1", "m2"], "rejected" if k == "rejected" else "candidate") for k in ("good", "rejected", "uncited", "foreign", "unshown", "digest", "said_no", "null", "later")] + [(None, "d", "p", ["m1"], "candidate")], "mention_id string, source_fact_digest string, person_instance string, evidence_ids array<string>, status string")
    good = {"mention_id": "good", "revision": 1, "source_fact_digest": "d", "person_instance": "p", "query_blind": True, "verdict": "supported", **{c: True for c in rendering.CHECKS}, "evidence_ids": ["m1"], "shown_media_ids": ["m1", "m9"], "request_sha256": "r", "model": "m"}
    change = {"good": {}, "rejected": {}, "uncited": {"evidence_ids": []}, "foreign": {"evidence_ids": ["m9"]}, "unshown": {"evidence_ids": ["m2"]}, "digest": {"source_fact_digest": "e"}, "said_no": {"owner_distinguished": False}, "null": {"query_blind": None}, "later": {}}
    rows = [good | {"mention_id": k} | v for k, v in change.items()] + [good | {"mention_id": "later", "revision": 2, "verdict": "unresolved"}, good | {"mention_id": None}]
    kinds = {"revision": "int", "evidence_ids": "array<string>", "shown_media_ids": "array<string>", "query_blind": "boolean", **{c: "boolean" for c in rendering.CHECKS}}
    r = spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in good))
    got = {x.mention_id: (x.status, x.reason) for x in rendering.reviewed_names(m, r).collect()}
    assert {k for k, v in got.items() if v == ("accepted", "local_visual_name_review")} == {"good"} and got["rejected"] == ("rejected", None) and got[None] == ("candidate", None)
    assert rendering.reviewed_names(m, r.limit(0)).where("status = 'accepted'").count() == 0
