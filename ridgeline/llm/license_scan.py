"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import table
from .license_rules import FRAGMENTS, SECTIONS

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Word characters are ASCII digits and letters and all bytes past ASCII.
_TO_SPACE = bytes(32 if (b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127) else (b + 32 if 65 <= b <= 90 else b) for b in range(256))

class Rule:
    """priority: lower goes first; keywords: words of which a text must have one."""

    __slots__ = ("label", "keywords", "pattern", "priority", "score")

    def __init__(self, label: str, keywords: str, pattern: str, priority: int, score: float):
        self.label, self.keywords, self.priority, self.score = label, keywords.split(), priority, score
        self.pattern = re.compile(rf"(?<= )(?:{pattern})(?= )")


def rules() -> list:
    """All rules in order of priority: sections from sure to vague, each as written."""
    out: list = []
    for _, score, lines in SECTIONS:
        for line in lines.strip().split("\n"):
            label, keywords, pattern = line.split(" | ")
            for name, fragment in FRAGMENTS.items():
                pattern = pattern.replace("{" + name + "}", fragment)
            out.append(Rule(label, keywords, pattern.replace("{{", "{").replace("}}", "}"), len(out), score))
    return out


def standing(found: list) -> list:
    """Matches (start, end, priority, ...) that lie inside no match of a higher priority, in order.

    What a suppressed match contains, its suppressor contains, so each is held only against all
    matches of higher priority: in order of starts, the least priority among ends at least as far, from a tree of minima.
    """
    ends = sorted({m[1] for m in found})
    rank = {e: len(ends) - i for i, e in enumerate(ends)}
    least = [len(found) + 10**9] * (len(ends) + 1)
    out = []
    for m in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        i, best = rank[m[1]], m[2]
        while i:
            best, i = min(best, least[i]), i - (i & -i)
        if best >= m[2]:
            out.append(m)
        i = rank[m[1]]
        while i < len(least):
            least[i], i = min(least[i], m[2]), i + (i & -i)
    return sorted(out)


class Scanner:
    """The rules by keyword; a document tries only those that have a keyword among its words."""

    def __init__(self):
        self.rules = rules()
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.keywords:
                self.by_word.setdefault(word, []).append(i)
        self.keywords = frozenset(self.by_word)

    def detect(self, padded: str) -> list:
        """(start, end, priority, label, score) left after suppression, in order; padded: normalised words between single spaces."""
        words = self.keywords.intersection(padded.split(" "))
        chosen = sorted({i for w in words for i in self.by_word[w]})
        return standing([(*m.span(), i, self.rules[i].label, self.rules[i].score) for i in chosen for m in self.rules[i].pattern.finditer(padded)])


def normalised(text: str) -> tuple:
    """The words as one string between single spaces, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " ", len(words)


def base_places(padded: str) -> list:
    """(place in the string, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


def word_index(padded: str, places: list) -> list:
    """The number of spaces before each place, from one pass over the text."""
    if not places:
        return []
    spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    return np.searchsorted(spaces, places).tolist()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, detections string"
_SCANNERS: list = []


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: places of base phrases, labels, and the surest detection.

    Null or empty text: no words, no labels, score 0. Null or repeated doc_id:
    rows as they stand. Empty table: empty result. Other columns are ignored.
    detections: label:first word:end word of each, in order.
    """

    def run(batches):
        import pyarrow as pa

        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        scanner = _SCANNERS[0]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string())
        for batch in batches:
            out: list = [[] for _ in kinds]
            for doc, text in zip(batch.column(0), batch.column(1)):
                padded, n = normalised(text.as_py() or "")
                base = base_places(padded)
                found = scanner.detect(padded)
                labels = {label for _, label in base}
                starts = word_index(padded, [i for i, _ in base])
                score = max([x[4] for x in found] + [0.7] * bool(base), default=0.0)
                first, last = word_index(padded, [x[0] for x in found]), word_index(padded, [x[1] for x in found])
                placed = ",".join(f"{x[3]}:{a - 1}:{b}" for x, a, b in zip(found, first, last))
                row = [doc.as_py(), n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[3] for x in found})), score, len(found), placed]
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_license_scan(spark, sf_dir):
    """Licences in every whole document."""
    return scan(table(spark, sf_dir, "documents"))
