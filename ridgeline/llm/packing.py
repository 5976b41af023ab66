"""Best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import re
import zlib
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, table

CAPACITY = 1024
END_ID = 2
#: Pieces of a part, about, over which the ranks of a length are counted, so that no length meets in one task; and parts, at least.
RANK_ROWS, RANK_PARTS = 20_000, 64
#: Ranges of sizes in which the sweeps of a superstep run side by side.
RANGES = 8
#: Sequences that are opened at once, of those that the pieces left need at least; all of them where these are few against those open.
OPENED, FEW = 0.65, 0.03

_MET = re.compile(r"\s\s").search

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(total: int, capacity: int) -> list:
    """(start, length) of the pieces of a document: all full but perhaps the first."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


class Encoder:
    """Token ids of texts, as the tokenizers library gives them for the same file.

    A text that holds the string of a special token goes through that library
    itself; all others through tiktoken with the file's own vocabulary in the
    order of its ranks, which gives the same ids in a fraction of the time.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        held = json.load(open(path, encoding="utf-8"))
        self.exact = Tokenizer.from_file(path)
        self.special = [x["content"] for x in held.get("added_tokens", [])]
        self.fast = self._fast(held)

    def _fast(self, held: dict):
        import tiktoken

        if held["model"]["type"] != "BPE" or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space") or held.get("normalizer"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        skip = set(self.special)
        ranks = {bytes(byte_of[c] for c in word): i for word, i in held["model"]["vocab"].items() if word not in skip}
        # Ranks must be in the order of merges, or ids would differ.
        single = {bytes([b]) for b in range(256)}
        merged = [ranks.get(bytes(byte_of[c] for c in "".join(pair.split(" ") if isinstance(pair, str) else pair))) for pair in held["model"]["merges"]]
        if not single <= ranks.keys() or any(a is None or b is None or a >= b for a, b in zip(merged, merged[1:])):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
        # Where no two white spaces meet, the branch that looks ahead is not needed.
        self.single = tiktoken.Encoding("file-single", pat_str=pattern + r"\s", mergeable_ranks=ranks, special_tokens={})
        return tiktoken.Encoding("file", pat_str=pattern + r"\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        if not _MET(text):
            return self.single.encode_ordinary(text)
        return self.fast.encode_ordinary(text)


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece; each text is encoded whole, once."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc.as_py(), k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


#: Kinds of runs: pieces of one length (size) and neighbouring ranks (from first on), open gaps of one size in neighbouring
#: sequences, gaps that a sweep has just used, and placements: pieces from rank first on, per of them in each sequence from sequence on, in gaps of that size.
PIECES_LEFT, GAPS, USED, PLACED = range(4)
RUNS = "kind int, size int, first long, count long, length int, per int, sequence long"


def successors(runs: list) -> list:
    """One sweep over sorted runs: every gap takes the longest pieces that fit and that no smaller gap has taken.

    Seen from a piece, it goes to its successor, the smallest gap that holds it; where more
    pieces than gaps meet, the longer win, equal ones by rank, and the others go on to the next
    gap. A gap takes as many pieces of one length as fit, as it stays the successor of
    that length until then. Gaps used wait for the next superstep.
    """
    out, stack = [], []
    for kind, size, first, count, *_ in sorted((r for r in runs if r[0] in (PIECES_LEFT, GAPS)), key=lambda r: (r[1], r[0], r[2])):
        if kind == PIECES_LEFT:
            stack.append([size, first, count])
            continue
        while count and stack:
            length, rank, left = stack[-1]
            per = min(size // length, left)
            used = min(count, left // per)
            out.append((PLACED, size, rank, used * per, length, per, first))
            out.append((USED, size - per * length, first, used, 0, 0, 0))
            first, count = first + used, count - used
            stack[-1][1:] = rank + used * per, left - used * per
            if not stack[-1][2]:
                stack.pop()
        if count:
            out.append((GAPS, size, first, count, 0, 0, 0))
    return [r for r in runs if r[0] in (USED, PLACED)] + out + [(PIECES_LEFT, length, rank, left, 0, 0, 0) for length, rank, left in stack]


def _swept(batches):
    import pyarrow as pa

    rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
    names, kinds = ("kind", "size", "first", "count", "length", "per", "sequence"), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    columns = list(zip(*successors(rows))) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))


def superstep(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Range-sorts runs of pieces and gaps, sweeps every range of sizes, then matches what the ranges have left with each other.

    Gaps of a range take its own pieces before those of lower ranges, so sweeping the rest
    of all ranges afterwards gives what one sweep over all would. Runs are bounded by
    the capacity and the supersteps, whatever the number of pieces.
    """
    held = runs.withColumn("kind", F.when(F.col("kind") == USED, GAPS).otherwise(F.col("kind"))).where(f"kind <> {GAPS} OR size > 0")
    ranged = held.repartitionByRange(RANGES, "size").mapInArrow(_swept, RUNS)
    return ranged.repartition(1).mapInArrow(_swept, RUNS)


def placements(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Supersteps until all pieces are placed: the runs of kind PLACED. lengths: length, count.

    Each superstep is written; one row of sums reaches the driver, which opens empty sequences when no gap
    holds the shortest piece left: a share of those that the pieces left would fill, so the
    longest come first, as in best fit decreasing.
    """
    spark = lengths.sparkSession
    empty = F.lit(0)
    state = lengths.select(F.lit(PIECES_LEFT).alias("kind"), F.col("length").cast("int").alias("size"), empty.cast("long").alias("first"), F.col("count").cast("long"), empty.alias("length"), empty.alias("per"), empty.cast("long").alias("sequence"))
    state = materialize(state, "runs0")
    opened, steps = 0, 0
    while True:
        left, gap = F.col("kind") == PIECES_LEFT, F.col("kind").isin(GAPS, USED)
        now = state.agg(F.sum(F.when(left, F.col("size") * F.col("count"))).alias("tokens"), F.min(F.when(left, F.col("size"))).alias("least"), F.max(F.when(gap, F.col("size"))).alias("most")).head()
        if not now.tokens:
            return state.where(F.col("kind") == PLACED)
        more = state
        if (now.most or 0) < now.least:
            need = ceil(now.tokens / capacity)
            many = need if need <= FEW * opened else ceil(OPENED * need)
            row = spark.range(1).select(*[F.lit(v).cast(t).alias(c) for c, t, v in (("kind", "int", GAPS), ("size", "int", capacity), ("first", "long", opened), ("count", "long", many), ("length", "int", 0), ("per", "int", 0), ("sequence", "long", 0))])
            more, opened = state.union(row), opened + many
        steps += 1
        last, state = state, materialize(superstep(more, capacity), f"runs{steps}")
        discard(last)


def ranked(pieces: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """Adds the rank of each piece among those of its length, from 0, in two steps; parts: of each length."""
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    upto = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("length", "_part").count().withColumn("_offset", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    return parted.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_offset") + F.row_number().over(own) - 1).drop("_part", "_offset")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all documents into few sequences by bulk-synchronous best fit.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Pieces of one length are alike but for their ranks, and neighbouring sequences with equal gaps but for their
    numbers, so both are sorted and matched as runs: supersteps of range-wise
    successor sweeps, conflicts resolved by rank, gaps updated, until none is left. Pieces are
    ranked within their length by hash parts, and each looks up its place by length and
    rank in the placements, whose number is bounded by the capacity and the
    supersteps; only they are broadcast.

    Null text: the end token alone. Ties, repeated doc_id or rows: packed as often as they
    stand there. Null doc_id: packed like others. Empty table: empty result.
    Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    pieces = materialize(tokenised_pieces(docs, tokenizer_path or default_tokenizer_path(), capacity, end_id), "pieces")
    plan = placements(pieces.groupBy("length").count(), capacity)
    by: dict[int, list] = {}
    for r in plan.orderBy("length", "first").collect():
        by.setdefault(r["length"], []).append((r["first"], r["sequence"], r["per"], capacity - r["size"]))
    held_plan = spark.sparkContext.broadcast({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in by.items()})

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                ranks, firsts, per, offsets = held_plan.value[int(value)]
                at = np.searchsorted(ranks, rank[mine], side="right") - 1
                place_in = rank[mine] - ranks[at]
                sequence[mine] = firsts[at] + place_in // per[at]
                offset[mine] = offsets[at] + place_in % per[at] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    parts = max(RANK_PARTS, ceil(pieces.count() / RANK_ROWS))
    held = ranked(pieces, parts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast(T.LongType()))
    return held.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
