"""Streams of append-only rows: tumbling counts, sessions, journal state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema of what is there; each file once."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def timed(df: DataFrame, column: str, late: str) -> DataFrame:
    """A zone-less column as a timestamp with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, column: str, width: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(column, width), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, column: str, gap: str, *keys: str) -> DataFrame:
    return df.groupBy(F.session_window(column, gap).alias("window"), *keys).agg(F.count("*").alias("n"))


def closed(spark: SparkSession, path: str, column: str, late: str, aggregate) -> DataFrame:
    """All rows of aggregate(events) over the files that are there now, each window once it is closed.

    Append mode into a file sink of the shared folder: nothing is held by the driver,
    and the state of a window goes when the watermark passes it. When all files are read, one
    row far ahead in time lets the watermark pass the last windows; its own stays open.
    """
    base = f"{shared_dir(spark)}/ridgeline-{uuid.uuid4().hex}"
    ends, out = f"{base}/end", f"{base}/out"
    rows = file_stream(spark, path)
    spark.createDataFrame([], rows.schema).write.parquet(ends)
    after = spark.readStream.schema(rows.schema).parquet(ends)
    events = aggregate(timed(rows.unionByName(after), column, late))

    def run() -> None:
        writer = events.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        writer.trigger(availableNow=True).start(out).awaitTermination()

    run()
    last = spark.read.parquet(path).agg(F.max(column).alias(column)).where(F.col(column).isNotNull())
    held = [(F.col(f.name) + F.expr("INTERVAL 36500 DAYS") if f.name == column else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    last.select(*held).write.mode("append").parquet(ends)
    run()
    return spark.read.schema(events.schema).parquet(out)
