"""Readers and sinks of evidence: bundles, questions, ledgers, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = (
    "STRUCT<fact_id: STRING, kind: STRING, predicate: STRING, value: STRING, carrier: STRING, roles: MAP<STRING,STRING>, "
    "evidence_by_slot: MAP<STRING,ARRAY<STRING>>, joint_evidence: ARRAY<STRING>, observed_media_ids: ARRAY<STRING>, "
    "unresolved_slots: ARRAY<STRING>, time_bounds: ARRAY<DOUBLE>, boundary_evidence: ARRAY<STRING>>"
)
MEDIA = "STRUCT<media_id: STRING, uri: STRING, pts: BIGINT, time_base: ARRAY<INT>, sha256: STRING>"
INSTANCE = (
    "STRUCT<instance_id: STRING, kind: STRING, description: STRING, track_ref: STRING, "
    "regions: ARRAY<STRUCT<media_id: STRING, box: ARRAY<DOUBLE>, source: STRING>>, attributes: ARRAY<STRUCT<dimension: STRING, value: STRING>>>"
)
OBSERVATION = f"STRUCT<observation_id: STRING, video_id: STRING, shot_id: STRING, media: ARRAY<{MEDIA}>, instances: ARRAY<{INSTANCE}>, facts: ARRAY<{FACT}>>"
LINK = "STRUCT<proposal_id: STRING, relation: STRING, source: STRING, target: STRING, verdict: STRING, evidence_ids: ARRAY<STRING>, basis: STRING>"
BUNDLE = f"`schema` STRING, video_id STRING, observations ARRAY<STRUCT<observation: {OBSERVATION}, link_proposals: ARRAY<{LINK}>>>"
QUESTION = "question_id STRING, video_id STRING, unit_id STRING, binding_type STRING, question_type STRING, question STRING, options MAP<STRING,STRING>, answer STRING"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row a bundle file, under an explicit schema; nothing is inferred from the data."""
    return spark.read.schema(BUNDLE).json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of questions; blank lines go."""
    return spark.read.schema(QUESTION).json(path).where("question_id IS NOT NULL")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the path is missing; anything else is raised
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def observations(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.explode("observations").alias("o")).select("o.observation.*", "o.link_proposals")


def media(obs: DataFrame) -> DataFrame:
    """Frames with their time in seconds."""
    m = obs.select("video_id", "observation_id", F.explode("media").alias("m")).select("video_id", "observation_id", "m.*")
    return m.withColumn("seconds", F.col("pts") * F.get("time_base", F.lit(0)) / F.get("time_base", F.lit(1)))


def facts(obs: DataFrame) -> DataFrame:
    return obs.select("video_id", "observation_id", F.explode("facts").alias("f")).select("video_id", "observation_id", "f.*")


def instances(obs: DataFrame) -> DataFrame:
    return obs.select("video_id", "observation_id", F.explode("instances").alias("i")).select("video_id", "observation_id", "i.*")


def fact_times(obs: DataFrame) -> DataFrame:
    """fact_id with its sorted distinct observed seconds, the first and the last."""
    at = facts(obs).select("fact_id", "video_id", F.explode_outer("observed_media_ids").alias("media_id"))
    t = at.join(media(obs).select("video_id", "media_id", "seconds"), ["video_id", "media_id"], "left").groupBy("fact_id").agg(F.array_sort(F.collect_set("seconds")).alias("observed_times"))
    return t.select("fact_id", "observed_times", F.array_min("observed_times").alias("t0"), F.array_max("observed_times").alias("t1"))


def write_snapshot(tables: dict, path: str) -> None:
    """Each table as Parquet, partitioned by video where it has one; Spark commits each whole or not at all."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("video_id") if "video_id" in df.columns else writer).parquet(f"{path}/{name}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
