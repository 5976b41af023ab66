"""The whole pipeline against a plain version on a small table."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from ridgeline.llm import packing
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_other_operators import filled
from tests.llm.test_pii import brute as personal


def table():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(8, 20))) + "."
    rows = []
    for i in range(60):
        text = "\n".join(line() for _ in range(rng.randrange(4, 12)))
        if i % 5 == 0:
            text += "\nHome | About | Contact"
        if i % 7 == 0:
            text += f"\nwrite to {word()}@{word()}.com please and thank you all."
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(100 + i, rows[i][1] + ("" if i % 2 else " extra"), "en", "b", 1) for i in range(12)]
    rows += [(200, "BUY!! NOW!! " * 40, "en", "a", 1), (201, "too short", "en", "a", 1), (202, None, "en", "a", 0), (203, "same words " * 60, "en", "c", 1)]
    return rows


def plain(rows):
    """(doc_id, text) of the documents that reach packing, with their number of copies."""
    kept = []
    for doc, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        bad = [x for x in text.split("\n") if " | " in x or x.count("!!") > 3]
        lost = sum(len(re.sub(r"\s", "", x)) for x in bad)
        if len(words) >= 20 and 100 * len(covered) <= 30 * len(words) and 100 * lost <= 30 * sum(map(len, words)):
            kept.append((doc, "\n".join(x for x in text.split("\n") if x not in bad), source))
    roots = {d: c for d, _, c in components([(d, t) for d, t, _ in kept])}
    kept = [(d, t, s) for d, t, s in kept if roots[d] == d]
    clean = []
    for doc, text, source in kept:
        out, at = "", 0
        for start, kind, end in personal(text):
            out, at = out + text[at:start] + "[" + ("EMAIL", "IP", "CARD", "PHONE")[kind] + "]", end
        clean.append((doc, out + text[at:], source))
    return clean


def test_pipeline(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = plain(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, longest = Counter(), Counter()
    for _, t, s in clean:
        sizes[s] += size(t)
        longest[s] = max(longest[s], size(t))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    encode = packing.encoder(packing.default_tokenizer_path())
    pieces = {}
    for doc, text, _ in clean:
        ids = np.array([*encode(text), 2], dtype="<u4")
        pieces[doc] = [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
    times = Counter(r.doc_id for r in got if r.piece == 0)
    assert set(times) <= set(pieces)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter({(d, *p): times[d] for d in times for p in pieces[d]})
    for s in sizes:
        taken = sum(times[d] * size(t) for d, t, x in clean if x == s)
        assert abs(taken - target[s]) <= longest[s] / 2 + 1
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


EXTRA = ("size", "n_ip", "_x", "_words", "_pii_x", "kept", "key__", "kept__0", "copies", "_key", "clean_text")


def test_stages_with_clashes_nulls_and_repeats(spark):
    """Every stage but the last returns the columns it got, with the values of extra ones; null and repeated ids lose no text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(2, 9)))
    text = lambda: " ".join(word() for _ in range(40)) + "."
    rows = [(i, t, s) for i, t, s in ((None, text(), "a"), (None, text(), None), (4, text(), "a"), (4, text(), "b"), (5, None, None), (6, "", "a"), (7, text() + " a@b.co", "b"), (8, " ".join([text()] + [word() for _ in range(9000)]), "c"))]
    rows += [(9, rows[2][1], "c"), (10, rows[2][1] + " more", "c")]
    schema = "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame([(d, t, s, None, None, *[f"{c}{i}" for c in EXTRA]) for i, (d, t, s) in enumerate(rows)], schema)
    kept = [r for r in rows if r[1]]
    unique = [r for r in kept if r[0] not in (9, 10)]
    want = {
        "quality_rules": sorted(t for _, t, _ in kept),
        "near_duplicates": sorted(t or "" for _, t, _ in [*unique, *rows[4:6]]),
        "redact": sorted((t or "").replace("a@b.co", "[EMAIL]") for _, t, _ in rows),
    }
    for name in ("quality_rules", "near_duplicates", "redact", "mix_sources"):
        stage = getattr(corpus_pipeline, name)
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        by_extra = {f"size{i}": r for i, r in enumerate(rows)}
        assert all(r["size"] in by_extra and r["doc_id"] == by_extra[r["size"]][0] and all(r[c] == c + r["size"][4:] for c in EXTRA) for r in got), name
        if name in want:
            assert sorted(r.text or "" for r in got) == want[name], name
        if name in ("quality_rules", "redact"):
            assert all(r.n_chars == len(r.text) for r in got)
        assert stage(spark, docs.where("false"), "").count() == 0
    pieces = corpus_pipeline.best_fit(spark, docs, "").collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)
    assert corpus_pipeline.best_fit(spark, docs.where("false"), "").count() == 0
