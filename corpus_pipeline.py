"""A training corpus from documents: clean, dedup, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import line_quality, mixing, near_dedup, packing, pii
from ridgeline.llm.common import fixed, guarded, materialize, table


def _plain(docs: DataFrame) -> tuple:
    """The columns that stages work on, the others under names that no operator uses, and the way back to docs' own columns."""
    return guarded(docs, ("doc_id", "text", "source"))


def _with_text(out: DataFrame, text, docs: DataFrame, back) -> DataFrame:
    """The columns of docs with another text and, where there is one, its number of characters."""
    new = fixed(out, {"new__": text}).drop("text").withColumnRenamed("new__", "text")
    held = back(new)
    if "n_chars" not in docs.columns:
        return held
    count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return held.select(*[count.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that the rules reject.

    Null, empty and blank texts: rejected, as they have fewer than 20 words. Null in other columns,
    ties, repeated rows, null or repeated doc_id: each row is judged by itself. Very long texts: whole. Empty table: empty
    result. Extra columns of any name: as they were.
    """
    plain, back = _plain(docs)
    judged = line_quality.judge(plain).where("kept")
    return _with_text(judged, F.col("clean_text"), docs, back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    The row with the least doc_id of its group; one without an id only where the whole group has none. Null and
    repeated doc_id: rows are as different as their texts, none goes but for a near-duplicate. Rows with
    one doc_id and one set of shingles: one of them. Texts without words: each a group of its own, kept. Very long
    texts: whole. Empty table: empty result. Extra columns of any name: as they were.
    """
    plain, back = _plain(docs)
    return back(near_dedup.deduplicated(plain))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind in brackets.

    Null text: empty. Null in other columns, ties, repeated rows, null or repeated doc_id: each row by itself, none goes. Very long
    texts: whole. Empty table: empty result. Extra columns of any name: as they were.
    """
    plain, back = _plain(docs)
    found = pii.find(plain)
    return _with_text(found, pii.redacted(F.coalesce(F.col("text"), F.lit("")), F.col("all_spans")), docs, back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Texts without words have no size and are not taken. Null source: a source of its own. Null doc_id: told apart by text; repeated
    doc_id and rows: rows of their own, of equal ones as many as are needed. Very long texts: whole. Empty table: empty
    result. Extra columns of any name: as they were.
    """
    plain, back = _plain(docs)
    return back(mixing.repeated(mixing.mix(plain), plain.columns))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 1024 tokens: one row a piece.

    Null and empty texts: the end token alone. Null and repeated doc_id, repeated rows, ties: packed as often as they stand
    there. Very long texts: cut into pieces, none lost. Empty table: empty result. Other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("best-fit packing", best_fit),
]

#: Tokens, signatures and trees can't be put in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
