"""Conversations as submissions to graphs of their own, with one planted fault in most of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import submissions
from ..sources.adapters import read


def _text(prefix: str):
    return F.concat(F.lit(prefix), F.col("c").cast("string"))


def _if(k: int, then, otherwise):
    """then where fault k is planted."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.col("k") == k, lit(then)).otherwise(lit(otherwise))


def _strings(*values):
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast("array<string>")


def _twice(df, k: int):
    """Rows of fault k stand twice."""
    return df.select("*", F.explode(F.sequence(F.lit(1), _if(k, 2, 1))).alias("again")).drop("again")


def tables(spark, sf_dir) -> tuple:
    """Graph, submissions and journal: conversation c has graph Gc and submission Sc, with fault c % 32 if that is 1 to 26."""
    turns = read(spark, sf_dir, "conversations").withColumn("c", F.col("conv_id"))
    spoken = turns.select(_text("G").alias("graph_id"), F.concat_ws(":", "conv_id", "turn").alias("utterance_id"), (F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 8).cast("double").alias("end"), "text")
    d = turns.where("turn = 0").select("c", (F.col("c") % 32).alias("k"), "text", F.concat(F.col("c").cast("string"), F.lit(":0")).alias("u"))
    graph, me, source = _text("G").alias("graph_id"), _text("I"), F.sha2(_text("G").cast("binary"), 256)
    known = submissions.Graph(
        audio=d.where("k <> 2").select(graph, source.alias("source_sha256"), _text("V").alias("source_video_id")),
        utterances=spoken,
        instances=d.select(graph, me.alias("instance_id"), F.lit("person").alias("kind"), _strings("m1", "m2", "m3").alias("media_ids")),
        media=d.select(graph, F.inline(F.array(*[F.struct(F.lit(m).alias("media_id"), F.lit(t).alias("seconds")) for m, t in (("m1", 1.0), ("m2", 2.0), ("m3", 30.0))]))),
        facts=d.select(graph, _text("E").alias("fact_id"), F.lit("event").alias("kind"), F.create_map(F.lit("agent"), me).alias("roles"), _strings("m1", "m2").alias("frames")),
    )
    name, sha = _text("S").alias("submission_id"), _if(3, "x", source).alias("source_sha256")
    utterance = _if(11, "nowhere", F.col("u"))
    speaker = [name, _text("P").alias("proposal_id"), _if(10, "knows", "speaker_of").alias("relation"), utterance.alias("utterance_id"), me.alias("local_instance"), _if(12, _strings("m1", "m9"), _if(16, _strings("m3"), _strings("m1"))).alias("media_ids")]
    speaker += [_if(13, _strings(_text("B"), "none"), _strings(_text("B"))).alias("evidence_ids"), *[F.lit(None).cast("string").alias(c) for c in ("event_fact_id", "event_role", "mention_utterance", "mention_text")]]
    event, role = _if(17, "none", _text("E")).alias("event_fact_id"), _if(18, "patient", "agent").alias("event_role")
    referent = [name, _text("Q").alias("proposal_id"), F.lit("refers_to_event_role").alias("relation"), F.col("u").alias("utterance_id"), me.alias("local_instance"), _if(20, _strings("m3"), _strings("m2")).alias("media_ids")]
    referent += [_if(21, _strings(_text("B")), _strings()).alias("evidence_ids"), event, role, F.col("u").alias("mention_utterance"), _if(19, "zzqqzz", F.upper(F.substring("text", 1, 4))).alias("mention_text")]
    reviews = d.select(name, _text("P").alias("proposal_id"), _if(22, "J", me).alias("local_instance"), utterance.alias("utterance_id"), _text("B").alias("evidence_id"), *[F.lit(None).cast("string").alias(c) for c in ("event_fact_id", "event_role")])
    reviews = reviews.union(d.select(name, _text("Q").alias("proposal_id"), me.alias("local_instance"), F.col("u").alias("utterance_id"), F.lit(None).cast("string").alias("evidence_id"), event, role))
    sent = submissions.Submissions(
        packets=_twice(d, 26).select(name, graph, _if(1, "other", submissions.SCHEMA_NAME).alias("schema"), sha, _if(4, "W", _text("V")).alias("video_id")),
        bundles=d.select(
            name, _text("B").alias("key"), _if(5, "other", _text("B")).alias("evidence_id"), sha, _if(14, 1.0, -1.0).alias("start"), _if(6, float("inf"), 20.0).alias("end"), _if(7, _strings("audio"), _strings("audio", "video")).alias("modalities"),
            F.lit(100).alias("audio_samples"), F.lit(5).alias("video_frames"), _if(8, "short", source).alias("clip_sha256"), F.lit("clip").alias("uri"), _if(15, _strings(), _strings(me)).alias("candidates"),
        ),
        bindings=_twice(d, 9).select(*speaker).union(d.select(*referent)),
        reviews=reviews,
        claims=_twice(d, 23).select(name, _text("C").alias("claim_id"), F.col("u").alias("source_utterance"), F.lit("reported_claim").alias("kind"), _if(24, F.concat("text", F.lit("!")), F.col("text")).alias("text"), F.lit(False).alias("world_fact")),
    )
    steps = [("submission", None), ("propose", _text("P")), ("propose", _text("Q")), ("revoke", _if(25, "Z", _text("Q")))]
    rows = F.array(*[F.struct(F.lit(i).alias("revision"), F.lit(o).alias("operation"), (F.lit(None) if p is None else p).cast("string").alias("proposal_id")) for i, (o, p) in enumerate(steps, 1)])
    journal = d.select(graph, name, F.inline(rows)).withColumn("payload", F.concat_ws("|", "submission_id", "revision", "operation", "proposal_id"))
    return sent, known, journal.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))


def submission_checks(spark, sf_dir):
    """All violations of the rules M1 to M26 over the submissions of all conversations."""
    return submissions.violations(*tables(spark, sf_dir))


QUERIES = [
    ("submission_checks", submission_checks, """WITH d AS (SELECT conv_id AS c, conv_id % 32 AS k FROM conversations WHERE turn = 0)
SELECT 'S' || c AS submission_id, 'M' || k AS rule, CASE WHEN k <= 4 THEN 'G' || c WHEN k <= 8 THEN 'B' || c WHEN k <= 16 THEN 'P' || c WHEN k <= 21 THEN 'Q' || c WHEN k = 22 THEN 'P' || c WHEN k <= 24 THEN 'C' || c WHEN k = 25 THEN '4' ELSE 'S' || c END AS subject
FROM d WHERE k BETWEEN 1 AND 26"""),
]
