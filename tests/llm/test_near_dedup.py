"""Near-duplicates against all pairs of full sets."""

import random
import re

import pyarrow as pa
import pytest

from ridgeline.llm import near_dedup, shingles


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [e for k, (e, _) in enumerate(sets) if find(k) == find(i) and e is not None]
        out.append((d, len(s), min(ids) if s and ids else d))
    return out


def near_copies(seed, groups, copies, size):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, size))]
        for _ in range(rng.randrange(1, copies)):
            edited = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                if rng.random() < 0.3 and len(edited) > 6:
                    del edited[rng.randrange(len(edited))]
                else:
                    edited[rng.randrange(len(edited))] = word()
            out.append(" ".join(edited))
    return out


def test_sets_match_plain_shingles():
    texts = ["", None, " \n", "One", "one", "a b c d", "a b c d e", "A b  c\td e f\x0bg É", "x " * 50, "é " * 9, "a b c d ", " end"] + near_copies(1, 20, 3, 80)
    sets = shingles.sets_of(pa.array(texts, pa.string()))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert list(sets[3]) == list(sets[4])
    plain = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(plain[i] & plain[j])


@pytest.mark.parametrize("light", [64, 6])
def test_components(spark, light, monkeypatch):
    """With short postings only, and with most links through hubs."""
    monkeypatch.setattr(near_dedup, "LIGHT", light)
    texts = near_copies(2, 40, 6, 120) + near_copies(3, 2, 70, 100)
    texts += ["", None, " ", "same words here", "Same words here", "tiny", "tiny"]
    rng = random.Random(4)
    ids = list(range(len(texts) + 5))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(ids[0], texts[0]), (None, texts[1])]
    got = near_dedup.link(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_empty(spark):
    assert near_dedup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
