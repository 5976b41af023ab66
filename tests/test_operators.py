"""Handmade cases of single operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geometry, text
from ridgeline.operators import entities, evaluate, events, identity, search, validate
from ridgeline.sources import bundles


def values(spark, column, inputs, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in d.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keywords(spark):
    match = lambda spec: lambda x: text.keyword_match(x, spec)
    assert values(spark, match("jump"), ["He jumps", "bungeejump", None]) == [True, False, False]
    assert values(spark, match('"sit on"'), ["sit  on it", "sit it on"]) == [True, False]
    assert values(spark, match("blond|blonde hat"), ["a Blonde with hats", "blond"]) == [True, False]
    assert values(spark, match("汽车"), ["红色汽车", "car"]) == [True, False]
    assert values(spark, match(""), [None, "x"]) == [True, True]
    assert text.keyword_terms('blond|"light hair" "sit on"') == [["blond", '"light'], ['hair"'], ["sit on"]] or text.keyword_terms('"sit on" a|b') == [["sit on"], ["a", "b"]]


def test_times(spark):
    assert values(spark, text.parse_time, ["1:02:03", "01:30.5", "x", None, "", "42"]) == [3723.0, 90.5, None, None, None, 42.0]
    assert [text.seconds(v) for v in ("1:02:03", "01:30.5", "x", None, 7)] == [3723.0, 90.5, None, None, 7.0]
    assert values(spark, text.mmss, [3723.0, None], "double") == ["62:03.0", "?"]
    assert search.resolve_time(100, period="middle_third", segment="2/3") == pytest.approx((100 / 3, 200 / 3), abs=0.4)
    assert search.resolve_time(100, around=50, tolerance=0) == (35, 65)
    assert search.resolve_time(100, period="unheard", segment="4/3") == (None, None)


def test_phonetic(spark):
    a, b = values(spark, text.phonetic_key, ["mukavat", "Muchova"])
    assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).head()[0] == 1


def test_answers(spark):
    d = spark.createDataFrame([("(B) yes", "multiple_choice"), ("true", "true_false"), ("F", "true_false"), (None, "multiple_choice")], "a string, k string")
    assert [r[0] for r in d.select(text.normal_answer(F.col("a"), F.col("k"))).collect()] == ["B", "True", "False", ""]


def test_bad_arguments():
    with pytest.raises(ValueError):
        search.Search(kinds=("unheard",))
    with pytest.raises(ValueError):
        search.Search(sort="random")
    assert search.Search(limit=1000).limit == 100


def test_dedup_groups_null_windows(spark):
    d = spark.createDataFrame([("F1", None, "a", "P1", "O1", 1), ("F2", None, "A ", "P1", "O1", 2), ("F3", 7, "a", "P1", "O1", 3)], "fact_id string, win long, predicate string, agent string, object string, t0 long")
    got = search.deduplicated(d, search.fact_key(), ["t0", "fact_id"]).orderBy("t0").collect()
    assert [(r.fact_id, r.multiplicity) for r in got] == [("F1", 2), ("F3", 1)]


def test_relative_cut(spark):
    d = spark.createDataFrame([(0.90,), (0.76,), (0.74,)], "sim double")
    assert sorted(r.sim for r in search.relative_cut(d).collect()) == [0.76, 0.90]


def test_process_chain(spark):
    d = spark.createDataFrame([("a", "F1", 0, 0), ("a", "F2", 6, 6), ("a", "F3", 20, 20)], "agent string, fact_id string, t0 long, t1 long")
    assert [(r.steps, r.fact_ids) for r in events.process_chains(d, 8).collect()] == [(2, "F1,F2")]


def test_alignment(spark):
    s = spark.createDataFrame([("u", 1, 100, 120)], "utterance_id string, k int, s_start long, s_end long")
    e = spark.createDataFrame([(i, 1, t, t) for i, t in enumerate((110, 130, 136, 86, 84))], "fact_id int, k int, e_start long, e_end long")
    got = {r.fact_id: (r.relation, r.gap) for r in events.aligned(s, e, 15, 7, ["k"]).collect()}
    assert got == {0: ("during", 0), 1: ("just_before", 10), 3: ("just_after", 14)}


def test_alignment_equals_all_pairs(spark):
    rng = random.Random(1)
    s = [(f"u{i}", i % 3, a, a + rng.randrange(0, 30)) for i, a in enumerate(rng.randrange(0, 300) for _ in range(40))]
    e = [(f"e{i}", i % 3, a, a + rng.randrange(0, 60)) for i, a in enumerate(rng.randrange(0, 300) for _ in range(40))]
    got = events.aligned(spark.createDataFrame(s, "u string, k int, s_start long, s_end long"), spark.createDataFrame(e, "f string, k int, e_start long, e_end long"), 5, 11, ["k"])
    want = sorted((a[0], b[0]) for a in s for b in e if a[1] == b[1] and a[3] >= b[2] - 5 and a[2] <= b[3] + 5)
    assert sorted((r.u, r.f) for r in got.collect()) == want


LINKS = "proposal_id string, source string, target string, verdict string, agent string"


def test_identity_chain_and_poison(spark):
    good = spark.createDataFrame([("1", "A", "B", "supported", "x"), ("2", "B", "C", "supported", "x")], LINKS)
    assert [(r.root, r.members) for r in identity.entities(identity.admitted(good)).collect()] == [("A", 3)]
    bad = good.union(spark.createDataFrame([("3", "A", "C", "contradicted", "x"), ("4", "D", "E", "unresolved", "x")], LINKS))
    assert {r.proposal_id: r.status for r in identity.admitted(bad).collect()} == {"1": "disputed", "2": "disputed", "3": "disputed", "4": "unresolved"}


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03d}" for i in range(120)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(f"z{i}", f"z{i + 1}") for i in range(40)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    rng.shuffle(pairs)
    got = {r.node: r.root for r in identity.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert all(got[x] == find(x) for p in pairs for x in p if p[0] != p[1])


def test_journal_fold(spark):
    rows = [("x", 1, "p1", "A", "B", "same"), ("x", 2, "p2", "B", "C", "same"), ("x", 3, "p3", "A", "C", "different"), ("x", 4, "p4", "A", "B", "same"), ("x", 5, "p5", "B", "C", "same")]
    got = {r.proposal_id: (r.status, r.reason) for r in identity.fold_journal(spark.createDataFrame(rows, "agent string, revision long, proposal_id string, source string, target string, relation string")).collect()}
    assert got == {"p1": ("revoked", "distinctness"), "p2": ("revoked", "distinctness"), "p3": ("accepted", ""), "p4": ("accepted", ""), "p5": ("deferred", "cluster_conflict")}
    journal = spark.createDataFrame([(1, "propose", "p"), (2, "revoke", "p"), (3, "propose", "q")], "revision long, operation string, proposal_id string")
    assert [r.proposal_id for r in identity.active_journal(journal).collect()] == ["q"]


def test_pair_metrics(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0), (3, 0)], "unit int, correct int")
    r = evaluate.pair_scores(d).head()
    assert (r.units, r.pair_accuracy, r.bir) == (3, pytest.approx(1 / 3), 0.5)


def test_iou_and_dot(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    r = spark.range(1).select(geometry.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)).alias("i"), geometry.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d")).head()
    assert (r.i, r.d) == (pytest.approx(1 / 3), 11.0)


def test_validation(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "k int, v double")
    rules = {"v is positive": "v > 0"}
    assert sorted(r.key for r in validate.violations(d, rules, F.col("k").cast("string")).collect()) == ["2", "3"]
    with pytest.raises(ValueError):
        validate.assert_valid(d, rules, F.col("k").cast("string"))
    chain = validate.chained(spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 6)], "agent string, sequence long, payload string"), "agent")
    assert validate.broken_links(chain, "agent", F.lit(False)).count() == 0
    assert validate.broken_links(chain.where("sequence <> 3"), "agent", F.lit(False)).count() > 0
    assert [r.fault for r in validate.broken_links(chain, "agent", F.col("sequence") == 2).collect()] == ["payload"]


def test_entity_aliases(spark):
    d = spark.createDataFrame([("F1", "event", "x", 5, 1, "agent", "P9"), ("F2", "event", "x", 1, None, "agent", "P2"), ("F3", "state", "y", 9, 1, "patient", "O1")], "fact_id string, kind string, predicate string, t0 long, win long, role string, entity string")
    assert {r.entity: r.alias for r in entities.aliases(d).collect()} == {"P2": "P1", "P9": "P2", "O1": "O1"}


def test_bundle_round_trip(spark, tmp_path):
    fact = {"fact_id": "f1", "kind": "event", "predicate": "hold", "roles": {"agent": "i1"}, "observed_media_ids": ["m2", "m1"]}
    obs = {"observation": {"observation_id": "o1", "video_id": "v", "media": [{"media_id": "m1", "pts": 10, "time_base": [1, 5]}, {"media_id": "m2", "pts": 25, "time_base": [1, 5]}], "instances": [], "facts": [fact]}, "link_proposals": []}
    (tmp_path / "in" / "v").mkdir(parents=True)
    (tmp_path / "in" / "v" / "observations.json").write_text(json.dumps({"schema": "s", "video_id": "v", "observations": [obs], "new": 1}))
    held = bundles.observations(bundles.read_bundles(spark, f"{tmp_path}/in/*/observations.json"))
    r = bundles.fact_times(held).head()
    assert (r.fact_id, r.observed_times, r.t0, r.t1) == ("f1", [2.0, 5.0], 2.0, 5.0)
    bundles.write_snapshot({"facts": bundles.facts(held).select("video_id", "fact_id")}, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/facts").where("video_id = 'v'").count() == 1
    assert bundles.read_or_empty(spark, f"{tmp_path}/none", bundles.QUESTION).count() == 0
    (tmp_path / "q.jsonl").write_text('{"question_id": "1", "options": {"A": "x"}}\n\n{"question_id": "2"}\n')
    assert bundles.read_questions(spark, f"{tmp_path}/q.jsonl").count() == 2
