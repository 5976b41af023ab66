"""Packing: ids against the library itself, gapless sequences, few sequences."""

import bisect
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from ridgeline.llm import packing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sequence_id", T.StringType())])
LONG = "alpha beta  gamma\n\n\tdelta's 12 don't été 你好 " * 400


def check(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer_path())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
        assert sum(m[2] for m in mine) == len(ids) * sum(1 for d, _ in texts if d == doc)
        for _, start, length, crc in mine:
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
    return seqs


def test_pack_edges(spark):
    texts = [(1, LONG), (2, None), (3, ""), (4, "one two <|endoftext|> three"), (5, "x " * 3000), (6, "short"), (6, "short"), (None, "no id")]
    rows = packing.pack(spark.createDataFrame([(d, t, "clash") for d, t in texts], SCHEMA)).collect()
    check(rows, [(d, t) for d, t in texts if d])
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def filled(rows, capacity):
    """Tokens of each sequence; pieces of a length must be placed once each, gaplessly."""
    fill, ranks = {}, {}
    for r in sorted(rows, key=lambda r: -r["size"]):
        for i in range(r["count"]):
            s, offset = r["sequence"] + i // r["per"], capacity - r["size"] + i % r["per"] * r["length"]
            assert fill.get(s, 0) == offset
            fill[s] = offset + r["length"]
        ranks.setdefault(r["length"], []).extend(range(r["first"], r["first"] + r["count"]))
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    assert max(fill.values(), default=0) <= capacity
    return fill, {k: len(v) for k, v in ranks.items()}


def plain_best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - x)
    return len(gaps)


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "thirds", "tiny", "few", "equal"])
def test_supersteps_against_plain_best_fit(spark, kind):
    """About as many sequences as best fit decreasing, one piece at a time, opens."""
    rng = np.random.default_rng(3)
    draw = {"lognormal": lambda: np.clip(rng.lognormal(4.5, 1.2, 3000), 1, 1024), "uniform": lambda: rng.integers(1, 1025, 3000), "thirds": lambda: rng.integers(200, 380, 3000), "tiny": lambda: rng.integers(1, 20, 3000), "few": lambda: rng.integers(1, 1025, 9), "equal": lambda: np.full(100, 300)}
    lengths = [int(x) for x in draw[kind]()]
    counts = {x: lengths.count(x) for x in set(lengths)}
    rows = packing.placements(spark.createDataFrame(list(counts.items()), "length long, count long")).collect()
    fill, placed = filled(rows, 1024)
    assert placed == counts and sum(fill.values()) == sum(lengths)
    assert set(fill) <= set(range(len(fill) + 1))
    best = plain_best_fit(lengths, 1024)
    assert len(fill) <= best * 1.002 + 1, (len(fill), best)


def test_ranges_sweep_as_one(spark):
    """Ranges side by side, then their rest, match what one sweep over everything matches."""
    rng = np.random.default_rng(8)
    runs = [(packing.PIECES_LEFT, x, 0, int(rng.integers(1, 9)), 0, 0, 0) for x in range(1, 1000, 7)] + [(packing.GAPS, int(x), 100 * i, int(rng.integers(1, 30)), 0, 0, 0) for i, x in enumerate(rng.integers(1, 1025, 60))]
    got = packing.superstep(spark.createDataFrame(runs, packing.RUNS)).collect()
    assert sorted(map(tuple, got)) == sorted(packing.successors(runs))
