"""Merkle fixity audit of WARC replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

FANOUT = 16
IDS_PER_FILE = 1000


#: Rows without an id are dealt over so many files by a hash of their record.
FILES_WITHOUT_ID = 4096
_LOWEST = -(2**63)


def record_of(page_id: Column, url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The bytes, as text, of a WARC resource record; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """Pages as records: page_id, file (of a thousand ids), record.

    Null page_id: files of their own, below all others.
    """
    rows = pages.select("page_id", record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    none = F.pmod(F.xxhash64("record"), F.lit(FILES_WITHOUT_ID)) + F.lit(_LOWEST)
    return rows.select("page_id", F.coalesce(F.floor(F.col("page_id") / IDS_PER_FILE).cast("long"), none).alias("file"), "record")


def write_warc(records: DataFrame, path: str) -> None:
    """One folder file=N with one WARC file for each file, records in order."""
    ordered = records.repartition("file").sortWithinPartitions("file", F.col("page_id").asc_nulls_first(), F.sha2(F.col("record").cast("binary"), 256))
    cut = F.substring("record", F.lit(1), F.char_length("record") - 2)  # the writer ends each row by the last line break
    ordered.select("file", cut.alias("value")).write.partitionBy("file").option("lineSep", "\r\n").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """page_id, file and record of what write_warc wrote, by the lengths that records state; a file is read by one task.

    What can't be read as a record, to the end of its file, is one record without page_id.
    """
    import re

    head = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?Content-Length: *([0-9]+)\r\n(?:[^\r\n]+\r\n)*\r\n", re.I)
    name = re.compile(rb"\r\nWARC-Record-ID: *<urn:page:(-?[0-9]+)>", re.I)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at = content.as_py(), 0
                while at < len(data):
                    m = head.match(data, at)
                    end = min(len(data), m.end() + int(m[1]) + 4) if m else len(data)
                    page = name.search(data, at, m.end()) if m else None
                    yield pa.RecordBatch.from_arrays([pa.array([int(page[1]) if page else None], pa.int64()), pa.array([file], pa.int64()), pa.array([data[at:end].decode("utf-8", "replace")], pa.string())], names=["page_id", "file", "record"])
                    at = end

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("file", "content").select(F.col("file").cast("long"), "content").mapInArrow(run, "page_id long, file long, record string")


def leaves(records: DataFrame) -> DataFrame:
    """Hashes of the records of one replica in order: file, position, page_id, start, length, digest.

    Only hashes and lengths are shuffled, never records. Equal page_ids stand
    in order of their digests; start is the offset of a record in its file.
    """
    hashed = records.select("file", "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    start = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return hashed.select("file", (F.row_number().over(order) - 1).cast("long").alias("position"), "page_id", F.coalesce(start, F.lit(0)).cast("long").alias("start"), "length", "digest")


def tree(held: DataFrame, height: int, fanout: int = FANOUT) -> list:
    """Levels of nodes from the leaves up, each (file, node, start, length, digest), every level written once.

    A node hashes its offset range and the digests of at most fanout children in
    order, so groups stay small whatever the size of a file.
    """

    def hashed(digests: Column) -> Column:
        return F.sha2(F.concat_ws(":", "start", "length", digests).cast("binary"), 256).alias("digest")

    level = held.select("file", F.col("position").alias("node"), "start", "length", hashed(F.col("digest")))
    out = [level]
    for k in range(height):
        children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "digest"))).alias("children")
        level = level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(children, F.min("start").alias("start"), F.sum("length").alias("length"))
        level = materialize(level.select("file", "node", "start", "length", hashed(F.array_join(F.transform("children", lambda c: c["digest"]), ":"))), f"nodes{k + 1}")
        out.append(level)
    return out


def height_of(*replicas: DataFrame, fanout: int = FANOUT) -> int:
    """Levels that bring the longest file of any replica to one root."""
    last = max((r.agg(F.max("position").alias("m")).head().m or 0) for r in replicas)
    height = 0
    while last >= 1:
        last, height = last // fanout, height + 1
    return height


def mismatches(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Positions (file, position) at which two replicas' leaves differ, found from the roots down.

    Each level joins only the children of nodes that differ above. A record that
    only one replica has differs.
    """
    height = height_of(a, b, fanout=fanout)
    left, right = tree(a, height, fanout), tree(b, height, fanout)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.select("file", "node", F.col("digest").alias("_a")).join(y.select("file", "node", F.col("digest").alias("_b")), ["file", "node"], "full_outer")
        return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "node")

    bad = materialize(differing(left[height], right[height]), "roots")
    for level in range(height - 1, -1, -1):
        above = bad.select("file", F.col("node").alias("_above"))

        def under(nodes: DataFrame) -> DataFrame:
            return nodes.withColumn("_above", F.floor(F.col("node") / fanout).cast("long")).join(above, ["file", "_above"], "left_semi").drop("_above")  # noqa: B023

        last, bad = bad, materialize(differing(under(left[level]), under(right[level])), f"level{level}")
        discard(last, left[level + 1], right[level + 1])
    return bad.select("file", F.col("node").alias("position"))


def audit(original: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row a record of the original, or of the replica alone: where it stands and whether it is intact.

    original, replica: page_id, file, record, as archive() or read_warc() gives them.
    Columns: page_id, file, position, start, length, digest, replica_digest, intact, and moved: not
    intact, but the replica's file holds the same record elsewhere, as after an insertion or a
    change of length before it.
    Empty replicas: every record differs. Ties and repeated records: in order of page_id and digest, each has a position.
    Null page_id: see archive(). Null, empty and very long pages: records like others. A file is sorted in one task by ids of about
    a thousand pages; other columns are ignored.
    """
    a, b = materialize(leaves(original), "original"), materialize(leaves(replica), "replica")
    bad = mismatches(a, b, fanout).withColumn("_bad", F.lit(True))
    key = ["file", "position"]
    there = b.join(bad, key, "left_semi")
    other = there.select(*key, F.col("digest").alias("_digest"), F.struct("page_id", "start", "length").alias("_other"))
    held_there = there.select("file", "digest").distinct().withColumn("_moved", F.lit(True))
    found = a.join(bad, key, "left").join(other, key, "full_outer").join(held_there, ["file", "digest"], "left")
    held = F.col("_bad").isNull() & F.col("digest").isNotNull()
    return found.select(
        F.coalesce("page_id", "_other.page_id").alias("page_id"), "file", "position", F.coalesce("start", "_other.start").alias("start"),
        F.coalesce("length", "_other.length").alias("length"), "digest", F.when(held, F.col("digest")).otherwise(F.col("_digest")).alias("replica_digest"), held.alias("intact"),
        (~held & F.coalesce("_moved", F.lit(False))).alias("moved"),
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica in which one record in 256, by a hash of its id, has another last character before the line ends: ? or, where that stands there, !."""
    hit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2) == "00"
    other = F.expr("CASE WHEN substring(record, char_length(record) - 4, 1) = '?' THEN '!' ELSE '?' END")
    cut = F.concat(F.expr("substring(record, 1, char_length(record) - 5)"), other, F.lit("\r\n\r\n"))
    return records.withColumn("record", F.when(hit, cut).otherwise(F.col("record")))


def op5_merkle_fixity(spark, sf_dir):
    """All pages as WARC records against a replica with known damage."""
    records = archive(table(spark, sf_dir, "pages"))
    return audit(records, damaged(records))


ORACLE = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
d AS (
  SELECT *, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '00' AS hit,
    substr(record, 1, length(record) - 5) || CASE WHEN substr(record, length(record) - 4, 1) = '?' THEN '!' ELSE '?' END || chr(13) || chr(10) || chr(13) || chr(10) AS short FROM r),
h AS (SELECT page_id, file, strlen(record) AS n, CASE WHEN hit THEN strlen(short) ELSE strlen(record) END AS m, hit, sha256(record) AS digest, CASE WHEN hit THEN sha256(short) ELSE sha256(record) END AS other FROM d),
o AS (
  SELECT page_id, file, CAST(row_number() OVER w - 1 AS BIGINT) AS position,
    CAST(coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(coalesce(sum(m) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS other_start,
    CAST(n AS BIGINT) AS length, digest, other, hit
  FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, file, position, start, length, digest, other AS replica_digest, NOT hit AND start = other_start AS intact, NOT hit AND start <> other_start AS moved FROM o
"""
