"""Quality rules against a plain Python count."""

import random
import re

from ridgeline.llm import line_quality


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bé", "c#", "你", "dd", "e|"])
    texts = [None, "", " \t\n", "one", "x " * 4000, "\x0b\x0c a\r\nb"]
    texts += ["".join(word() + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    block = " ".join(f"w{i}" for i in range(30))
    texts += [block + " " + block + " tail", block + "\n" + block + "\nzz " + block[:40]]
    rows = line_quality.judge(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
    assert line_quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_go_first(spark):
    clean = "".join(" ".join(f"word{i}x{j}" for j in range(9)) + ".\n" for i in range(12))
    texts = [clean, clean + "Home | About | Contact | Login\nAll rights reserved.", "SHOUT!! AT!! ALL!! OF!! YOU!! " * 2 + "\n" + "a | b | c | d | e | f | g | h | i | j | k | l | m"]
    rows = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].kept and rows[0].clean_text == clean and rows[0].n_bad_lines == 0
    assert rows[1].kept and rows[1].n_bad_lines == 2 and rows[1].clean_text == clean.rstrip("\n")
    assert not rows[2].kept
