"""Shared storage between the steps of a plan, and joins that split hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than one part of so many is hot, so there are fewer than PARTS of them ...
PARTS = 2000
#: ... and none is hot below this.
LEAST_HOT = 100
#: Up to so many rows a join is one shuffle, hot keys or not: they fit in any task.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's checkpoint folder.

    Where none is set, local mode (one machine) makes one; a cluster must name it.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeline-checkpoint-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no executor holds any of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ridgeline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ridgeline_path = path
    return out


def discard(*held: DataFrame) -> None:
    """Deletes tables that written() made, once all that is read from them is written itself."""
    for df in held:
        spark, path = df.sparkSession, getattr(df, "_ridgeline_path", None)
        if path:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def join_split(many: DataFrame, one: DataFrame, key: str, how: str = "inner", small: int = SMALL) -> DataFrame:
    """many joined to one, which has each key once, without a task for all rows of a hot key.

    Keys with more than 1 / PARTS of the rows are fewer than PARTS, so their rows of
    one are broadcast and the rows of many stay where they are; the others are
    shuffled. how: inner, left or left_semi. Null keys match nothing. Up to small
    rows all are shuffled.
    """
    rows = many.count()
    if rows <= small:
        return many.join(one, key, how)
    hot = written(many.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(rows // PARTS, LEAST_HOT)).select(key), "hot")
    if hot.isEmpty():
        return many.join(one, key, how)
    held = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    first = many.join(F.broadcast(hot), key, "left_semi").join(held, key, how)
    return first.union(many.join(F.broadcast(hot), key, "left_anti").join(one, key, how))
