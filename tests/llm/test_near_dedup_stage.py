"""The near-duplicate stage: its similarity, and which rows it leaves."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import near_dedup
from tests.llm.test_near_dedup import shingle_set

SCHEMA = "doc_id long, text string, source string"


def left(spark, rows):
    return sorted((tuple(r) for r in near_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def similarity(a, b):
    return len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))


def banded(seed, groups):
    """Pairs of texts with a similarity from 0.80 to below 0.85."""
    rng = random.Random(seed)
    out = []
    while len(out) < groups:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 160))]
        edited = list(base)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(len(edited))] = f"v{rng.randrange(10**6)}"
        pair = " ".join(base), " ".join(edited)
        if 0.8 <= similarity(*pair) < 0.85:
            out.append(pair)
    return out


def test_matches():
    assert (near_dedup.matches(85), near_dedup.matches(80)) == (36, 31)


@pytest.mark.parametrize("light", [64, 1])
def test_stage_takes_pairs_from_080(spark, light, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIGHT", light)
    pairs = banded(1, 25)
    rows = [(2 * i + k, t, "a") for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    assert [r[0] for r in sorted(left(spark, rows))] == [2 * i for i in range(25)]
    strict = near_dedup.link(spark.createDataFrame(rows, SCHEMA)).where("kept").count()
    assert strict == 50


def test_rows_with_null_or_repeated_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(None, a, "x"), (None, b, "x"), (None, b + " more", "x"), (7, c, "y"), (7, d, "y"), (7, d, "y"), (3, e, "z"), (9, e + " more", "z"), (None, e, "z"), (9, f, "z"), (5, g, "z"), (4, g, "z")]
    rows += [(None, None, "blank"), (None, "", "blank"), (8, " ", "blank")]
    got = left(spark, rows)
    assert [r for r in got if r[2] == "blank"] == sorted(rows[-3:], key=str)
    words = [r[:2] for r in got if r[2] != "blank"]
    of_b = [r for r in words if r[0] is None and r[1].startswith(b)]
    assert len(of_b) == 1
    assert sorted((r for r in words if r not in of_b), key=str) == sorted([(None, a), (7, c), (7, d), (3, e), (9, f), (4, g)], key=str)


def test_bitmaps_bound_what_sets_share(spark):
    """size - only() is never less than the intersection, and exact for small sets that don't collide."""
    rng = random.Random(5)
    pairs = []
    for n in (0, 1, 5, 60, 900):
        pool = [rng.randrange(-(2**63), 2**63) for _ in range(2 * n + 1)]
        pairs += [(rng.sample(pool, n), rng.sample(pool, n // 2 + 1)) for _ in range(8)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    d = d.withColumn("x", near_dedup.bits(F.col("a"))).withColumn("y", near_dedup.bits(F.col("b")))
    for r in d.select("i", (F.size("a") - near_dedup.only("x", "y")).alias("most")).collect():
        a, b = pairs[r.i]
        assert r.most >= len(set(a) & set(b))
        if len({x % 1024 for x in a + b}) == len(set(a + b)):
            assert r.most == len(set(a) & set(b))
