"""Mixing, archives, licences, secrets and the classifier against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ridgeline.llm import classifier, license_scan, mixing, secret_scan, warc_fixity

# ---- mixing


def filled(sizes, weights):
    """Water-filling as rounds of clamping and resharing."""
    target, open_ = {}, dict(weights)
    left = float(sum(sizes.values()))
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if w * left / total >= 3 * sizes[s]]
        if not over:
            target.update({s: w * left / total for s, w in open_.items()})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(["a", "b", "é", "Z", None, "tiny"] + ["big"] * 9), 5) for i in range(600)]
    rows += [(None, "null id words", "a", 5), (3, None, "a", 5), (3, " \t", "b", 5), (7, "one two", "alone", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, longest = {}, {}
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in got}
    assert mixing.repeated(mixing.mix(d), ["doc_id", "text"]).count() == sum(r.copies for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# ---- archives


def test_fixity(spark):
    pages = [(i, f"http://x/{i}", "<p>" + "é" * (i % 50) + "</p>") for i in range(300)] + [(None, None, None), (5, "http://x/again", "<b>"), (1700, "u", "")]
    records = warc_fixity.archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    clean = warc_fixity.audit(records, records).collect()
    assert len(clean) == len(pages) and all(r.intact for r in clean)
    at = 0
    for r in sorted((r for r in clean if r.file == 0), key=lambda r: r.position):
        assert r.start == at
        at += r.length
    broken = records.selectExpr("page_id", "file", "CASE WHEN page_id IN (17, 299, 1700) THEN replace(record, 'resource', 'resourcf') ELSE record END AS record")
    assert {r.page_id for r in warc_fixity.audit(records, broken).where("NOT intact").collect()} == {17, 299, 1700}
    short = warc_fixity.audit(records, records.where("page_id IS NULL OR page_id <> 1700")).where("NOT intact").collect()
    assert [r.page_id for r in short] == [1700] and short[0].replica_digest is None
    none = records.where("false")
    assert warc_fixity.audit(none, none).count() == 0
    assert warc_fixity.audit(records, none).where("NOT intact").count() == len(pages)


def test_record_hash(spark):
    r = warc_fixity.leaves(warc_fixity.archive(spark.createDataFrame([(3, "u", "<é>")], "page_id long, url string, html string"))).head()
    want = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: 4\r\n\r\n<é>\r\n\r\n"
    assert r.digest == hashlib.sha256(want.encode()).hexdigest() and r.length == len(want.encode())


# ---- licences


def test_licenses(spark):
    texts = [
        None, "", "Released under the MIT License.", "the APACHE license, version 2.0; mit   license!", "This work is licensed under the GNU General Public License, version 3.",
        "commit licenses are permitted", "SPDX-License-Identifier: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit license mit license é", "Licensed under CC BY-NC 4.0.",
    ]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert rows[5].labels == "" and rows[6].labels == "bsd-3-clause" and rows[7].labels == "mit" and rows[9].labels == "cc-by-nc"
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(license_scan.rules()) > 250


# ---- secrets


def plain_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "ſecret", "short", "x.y/z+long_enough"]
    texts = [None, "", "a" * 40000, "f" * 40000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts += ["session auth bearer Zx81kLm9QpT77vN2c4R8", "the word internationalization123 here"]
    rows = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = plain_secrets(t)
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)], t
        named = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(filter(None, r.spans.split(",")))
    assert "novel:" in rows[len(texts) - 2].spans and rows[len(texts) - 1].spans == ""
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- classifier


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    m = classifier.train(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = classifier.train(x[:10], np.ones(10))
    assert one.score(x).min() > 0.5
    assert len(classifier.train(np.zeros((0, 5)), np.zeros(0)).score(x)) == 3000


def test_classifier(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "of", "the", "evening,", "light."]) + str(rng.randrange(50)) for _ in range(80))
    bad = lambda: "BUY NOW!! " * rng.randrange(5, 60)
    docs = [(i, good() if i % 3 else bad(), "x") for i in range(400)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0), (100000, 1, 0)]
    d = spark.createDataFrame(docs + [(None, None, "x"), (7, "", "x")], "doc_id long, text string, score string")
    m = classifier.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_rows=300)
    rows = classifier.classify(d, m).collect()
    assert len(rows) == 402
    held = [r for r in rows if r.held_out and r.doc_id is not None]
    assert {r.doc_id for r in held} >= {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == int(bool(r.doc_id % 3)) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


# ---- archives, read and written


def test_archives_round_trip_and_insertions(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "é?" * i if i % 5 else None) for i in range(-3, 40)] + [(None, None, None), (None, "u", "no id"), (7, "again", "x")]
    records = warc_fixity.archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    warc_fixity.write_warc(records, str(tmp_path / "warc"))
    back = warc_fixity.read_warc(spark, str(tmp_path / "warc"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, back.select("page_id", "file", "record").collect()), key=key) == sorted(map(tuple, records.select("page_id", "file", "record").collect()), key=key)
    files = {r.file for r in records.where("page_id IS NULL").collect()}
    assert not files & {r.file for r in records.where("page_id IS NOT NULL").collect()}
    audited = warc_fixity.audit(records, back).collect()
    assert len(audited) == len(pages) and all(r.intact and not r.moved for r in audited)
    more = records.union(warc_fixity.archive(spark.createDataFrame([(20, "new", "inserted")], "page_id long, url string, html string")))
    rows = warc_fixity.audit(records.where("page_id >= 0"), more.where("page_id >= 0")).collect()
    assert all(r.intact or r.moved or r.digest is None for r in rows) and sum(r.moved for r in rows) >= 19


# ---- trees


def test_traversal_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    model = classifier.train(x, y, trees=40, depth=3)
    for row, score in zip(x[:100], model.score(x[:100])):
        total = model.prior
        for tree in range(len(model.value)):
            node = 0
            while node < 2**model.depth - 1:
                node = 2 * node + (2 if row[model.feature[tree, node]] > model.threshold[tree, node] else 1)
            total += model.value[tree, node - (2**model.depth - 1)]
        assert abs(1 / (1 + math.exp(-total)) - score) < 1e-12
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "other text", 5), (None, None, 5), (2, "", 5), (3, "x " * 9000, 5)], "doc_id long, text string, score int")
    assert classifier.classify(none, classifier.fit(none, labels)).count() == 0
    assert {r.score for r in classifier.classify(docs, classifier.fit(docs, labels)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    rows = classifier.classify(docs, classifier.fit(docs, some)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


# ---- novelty


def test_novelty_against_plain_sizes(spark):
    import zstandard

    held = zstandard.ZstdCompressionDict(secret_scan.PRIME.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda t: len(zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(t.encode()))
    texts = ['secretKey = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"', "password: getElementByIdgetElementById", "plain prose Zx81kLm9QpT77vN2c4R8 here", "token=Zx81kLm9QpT77vN2c4R8"]
    novelty = secret_scan.Novelty()
    for t in texts:
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=.~-]{16,}", t):
            before, after = t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 48]
            score = (size(before + " " + after + " " + m[0]) - size(before + " " + after)) / len(m[0])
            context = before + m[0].partition("=")[0] if "=" in m[0] else before
            if secret_scan.sensitive(context) and score >= secret_scan.NOVELTY and secret_scan.entropy(m[0]) >= secret_scan.ENTROPY:
                want.append((m.start(), m.end(), score))
        assert secret_scan.novel_spans(t, novelty) == want
    assert [bool(secret_scan.novel_spans(t, novelty)) for t in texts] == [True, False, False, True]
    d = spark.createDataFrame([(1, texts[0], "x"), (None, None, "y")], "doc_id long, text string, spans string")
    assert [(r.n_novel, r.doc_id) for r in sorted(secret_scan.scan(d).collect(), key=lambda r: str(r.doc_id))] == [(1, 1), (0, None)]
