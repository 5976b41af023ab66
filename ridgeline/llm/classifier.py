"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "upper_words", "title_words", "upper_letters", "digits",
    "punctuation", "symbols", "bars", "shouts", "sentence_ends", "commas", "other_bytes", "distinct_words", "top_word", "same_next",
    "symbol_words", "lines", "line_length", "same_lines", "short_lines", "distinct_pairs", "spaces",
)

#: Labelled rows used for training, at most: those with the smallest hash of doc_id.
MAX_TRAIN_ROWS = 20_000

_KIND = np.zeros((256, 8), np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _b < 128 and _c in "!\"'(),-./:;?[]_`{}~@^\\+=", _c in "#*$%&|<>" and _b < 128, _b >= 128, _b in (32, 9, 13), _b == 10)
_SYMBOLS = frozenset("#*$%&|<>!")


def statistics(text: str) -> list:
    """The values of FEATURES for one whole text."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower, digits, marks, symbols, other, spaces, _ = (int(x) for x in raw @ _KIND)
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [float(np.log1p(chars))] + [0.0] * (len(FEATURES) - 1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    letters = max(1, upper + lower)
    return [
        float(np.log1p(chars)), float(np.log1p(n)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes < 3).mean()),
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, upper / letters, digits / chars, marks / n, symbols / n,
        int(raw[124]) / n, int(raw[33]) / n, int(raw[46] + raw[63]) / n, int(raw[44]) / n, other / chars, len(counts) / n ** 0.8,
        max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, sum(w[-1] in _SYMBOLS for w in words) / n, len(lines) / n,
        float(np.log1p(chars / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        pairs / max(1, n - 1), spaces / n,
    ]


class Model:
    """Trees of equal depth, flattened: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, feature, threshold, value, prior: float, depth: int):
        self.feature, self.threshold, self.value, self.prior, self.depth = feature, threshold, value, prior, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, all rows and trees at once, level by level."""
        if not len(x):
            return np.zeros(0)
        total = np.full(len(x), self.prior)
        if len(self.value):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.value))[None, :]
            node = np.zeros((len(x), len(self.value)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total = total + self.value[trees, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, penalty: float = 2.0, least: float = 5.0) -> Model:
    """Logistic loss, second order, over histograms of quantile bins. The same rows give the same trees."""
    rate_of = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    prior = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) < 2 or y.min() == y.max():
        return Model(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    total, out = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.full(many, 1e-9)
            cut = np.full(many, bins + 1)
            for j in range(x.shape[1]):
                at = local * bins + binned[:, j]
                g = np.bincount(at, grad, many * bins).reshape(many, bins).cumsum(1)
                h = np.bincount(at, hess, many * bins).reshape(many, bins).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
                gain[(h < least) | (ht - h < least)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best[better] = gain[np.arange(many), k][better]
                for m in np.flatnonzero(better):
                    feature[first + m], threshold[first + m], cut[m] = j, edges[j][k[m]], k[m]
            chosen = feature[node]
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen] > cut[local])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + penalty)
        total = total + value[leaf]
        out.append((feature, threshold, value))
    return Model(*(np.stack(c) for c in zip(*out)), prior, depth)


_SCHEMA = "doc_id long, x array<double>"


def _statistics_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def remainder():
    """crc32 of doc_id as text, modulo 3; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, **parameters) -> Model:
    """Fits to labelled rows outside the held-out third, at most max_rows of them.

    The sample is a number of ids, so it is broadcast to the documents, and only
    the statistics of each reach the driver, once an id. Repeated labels of a document are averaged. Null labels and ids: not
    used. No documents or no labels: a model that scores one half everywhere.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 1))
    usable = usable.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    sample = usable.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    rows = [(r.doc_id, r.quality) for r in sample.collect()]
    if not rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(d,) for d, _ in rows], "doc_id long")
    held = _statistics_of(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    # One row an id reaches the driver, however often the id stands in the documents: its least statistics.
    held = held.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    quality = dict(rows)
    return train(np.array([r.x for r in held]).reshape(-1, len(FEATURES)), np.array([quality[r.doc_id] for r in held]), **parameters)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score and predicted.

    Null and empty texts get the score of empty statistics. Null doc_id: not held
    out. Repeated rows: rows as they stand. Empty table: empty result. Other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(2)]).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (remainder() == 1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark, sf_dir):
    """Scores of all documents by a model of the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
