"""Checks of whole submissions against the graph they are for: one table of violations.

A submission is a packet with evidence bundles, bindings of utterances to persons, their reviews, and claims. Every rule is a
predicate over a row, or an anti-join against what the graph knows; nothing is looped over. A submission
without rows here may be committed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold

#: The schema name of packets, and the two relations of bindings.
SCHEMA_NAME = "rrt.multimodal.v1"
RELATIONS = ("speaker_of", "refers_to_event_role")


@dataclass
class Graph:
    """What is known, by graph_id: audio (source_sha256, source_video_id), utterances (utterance_id, start, end, text), instances
    (instance_id, kind, media_ids), media (media_id, seconds), facts (fact_id, kind, roles: map to instances, frames: array of media_ids)."""

    audio: DataFrame
    utterances: DataFrame
    instances: DataFrame
    media: DataFrame
    facts: DataFrame


@dataclass
class Submissions:
    """What is submitted, by submission_id: packets (graph_id, schema, source_sha256, video_id), bundles (key, evidence_id, source_sha256, start, end,
    modalities, audio_samples, video_frames, clip_sha256, uri, candidates), bindings (proposal_id, relation, utterance_id, local_instance, media_ids,
    evidence_ids, event_fact_id, event_role, mention_utterance, mention_text), reviews (proposal_id, local_instance, utterance_id,
    evidence_id, event_fact_id, event_role), claims (claim_id, source_utterance, kind, text, world_fact)."""

    packets: DataFrame
    bundles: DataFrame
    bindings: DataFrame
    reviews: DataFrame
    claims: DataFrame


def _rows(df: DataFrame, subject: str, rules: dict) -> DataFrame:
    """A row for each rule whose condition holds; an unknown (null) condition is no violation."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return df.select("submission_id", F.explode(found).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _none(x: str) -> Column:
    return F.size(F.coalesce(x, F.array())) == 0


def _outside(inner: str, outer: str) -> Column:
    """Whether some element of one array is not in the other."""
    return F.size(F.array_except(F.coalesce(inner, F.array().cast("array<string>")), F.coalesce(outer, F.array().cast("array<string>")))) > 0


def packet_violations(s: Submissions, g: Graph) -> DataFrame:
    """M1 schema, M2 audio present, M3 source digest, M4 video."""
    audio = g.audio.select("graph_id", F.col("source_sha256").alias("known_sha256"), "source_video_id", F.lit(True).alias("heard"))
    p = s.packets.join(audio, "graph_id", "left")
    return _rows(p, "graph_id", {"M1": ~F.col("schema").eqNullSafe(SCHEMA_NAME), "M2": F.col("heard").isNull(), "M3": F.col("source_sha256") != F.col("known_sha256"), "M4": F.col("video_id") != F.col("source_video_id")})


def bundle_violations(s: Submissions) -> DataFrame:
    """M5 id and digest, M6 interval, M7 both modalities, M8 where the clip is from."""
    b = s.bundles.join(s.packets.select("submission_id", F.col("source_sha256").alias("packet_sha256")), "submission_id")
    finite = F.abs("start").between(0, 1.7e308) & F.abs("end").between(0, 1.7e308)
    both = (F.size(F.array_distinct("modalities")) == 2) & F.array_contains("modalities", "audio") & F.array_contains("modalities", "video")
    rules = {
        "M5": ~F.col("key").eqNullSafe(F.col("evidence_id")) | ~F.col("source_sha256").eqNullSafe(F.col("packet_sha256")),
        "M6": ~F.coalesce(finite & (F.col("start") < F.col("end")), F.lit(False)),
        "M7": ~F.coalesce(both & (F.col("audio_samples") > 0) & (F.col("video_frames") >= 2), F.lit(False)),
        "M8": ~F.coalesce((F.char_length("clip_sha256") == 64) & (F.col("uri") != ""), F.lit(False)),
    }
    return _rows(b, "key", rules)


def binding_violations(s: Submissions, g: Graph) -> DataFrame:
    """M9 to M21: of all bindings, then of speakers with their bundles, then of referents with their events."""
    graph_of = s.packets.select("submission_id", "graph_id").distinct()
    people = g.instances.where("kind = 'person'").select("graph_id", F.col("instance_id").alias("local_instance"), F.col("media_ids").alias("anchors"))
    spoken = g.utterances.select("graph_id", "utterance_id", F.col("start").alias("u_start"), F.col("end").alias("u_end"), F.col("text").alias("u_text"))
    b = s.bindings.join(graph_of, "submission_id").join(people, ["graph_id", "local_instance"], "left").join(spoken, ["graph_id", "utterance_id"], "left")
    b = b.withColumn("same_id", F.count("*").over(Window.partitionBy("submission_id", "proposal_id")))
    every = {
        "M9": F.col("same_id") > 1,
        "M10": ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)),
        "M11": F.col("anchors").isNull() | F.col("u_start").isNull(),
        "M12": F.col("anchors").isNotNull() & (_none("media_ids") | _outside("media_ids", "anchors")),
    }
    out = _rows(b, "proposal_id", every)
    known = b.where(F.col("anchors").isNotNull() & F.col("u_start").isNotNull())
    speakers = known.where("relation = 'speaker_of'")
    key = ["submission_id", "proposal_id"]
    cited = speakers.select(*key, "u_start", "u_end", "local_instance", F.explode(F.array_distinct("evidence_ids")).alias("key"))
    shown = s.bundles.select("submission_id", "key", "start", "end", "candidates")
    met = cited.join(shown, ["submission_id", "key"], "left")
    dangling = speakers.where(_none("evidence_ids")).select("submission_id", "proposal_id").union(met.where("start IS NULL").select("submission_id", "proposal_id"))
    out = out.union(dangling.distinct().select("submission_id", F.lit("M13"), "proposal_id"))
    out = out.union(_rows(met, "proposal_id", {"M14": (F.col("start") > F.col("u_start")) | (F.col("end") < F.col("u_end")), "M15": F.col("start").isNotNull() & ~F.coalesce(F.array_contains("candidates", F.col("local_instance")), F.lit(False))}).distinct())
    frames = speakers.select("graph_id", *key, F.explode("media_ids").alias("media_id")).join(g.media, ["graph_id", "media_id"]).select(*key, "seconds")
    inside = frames.join(met.where("start IS NOT NULL").select(*key, "start", "end"), key).where("seconds BETWEEN start AND end").select(*key).distinct()
    out = out.union(met.where("start IS NOT NULL").select(*key).distinct().join(inside, key, "left_anti").select("submission_id", F.lit("M16"), "proposal_id"))
    events = g.facts.where("kind = 'event'").select("graph_id", F.col("fact_id").alias("event_fact_id"), "roles", "frames")
    r = known.where("relation = 'refers_to_event_role'").join(events, ["graph_id", "event_fact_id"], "left")
    literal = F.contains(casefold(F.col("u_text")), casefold(F.col("mention_text"))) & F.col("mention_utterance").eqNullSafe(F.col("utterance_id")) & (F.col("mention_text") != "")
    there = F.col("roles").isNotNull()
    referents = {
        "M17": ~there,
        "M18": there & ~F.element_at("roles", F.col("event_role")).eqNullSafe(F.col("local_instance")),
        "M19": ~F.coalesce(literal, F.lit(False)),
        "M20": there & _outside("media_ids", "frames"),
        "M21": ~_none("evidence_ids"),
    }
    return out.union(_rows(r, "proposal_id", referents))


def review_violations(s: Submissions) -> DataFrame:
    """M22: a review speaks of the endpoint, utterance, evidence and event role of its binding."""
    b = s.bindings.select("submission_id", "proposal_id", "relation", "evidence_ids", *[F.col(c).alias(f"own_{c}") for c in ("local_instance", "utterance_id", "event_fact_id", "event_role")])
    r = s.reviews.join(b, ["submission_id", "proposal_id"])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    of_speaker = (F.col("relation") == "speaker_of") & ~F.coalesce(F.array_contains("evidence_ids", F.col("evidence_id")), F.lit(False))
    of_referent = (F.col("relation") == "refers_to_event_role") & (differs("event_fact_id") | differs("event_role"))
    return _rows(r, "proposal_id", {"M22": differs("local_instance") | differs("utterance_id") | of_speaker | of_referent}).distinct()


def claim_violations(s: Submissions, g: Graph) -> DataFrame:
    """M23 unique ids, M24 the literal text of an utterance, reported and never a fact of the world."""
    said = g.utterances.select("graph_id", F.col("utterance_id").alias("source_utterance"), F.col("text").alias("u_text"))
    c = s.claims.join(s.packets.select("submission_id", "graph_id").distinct(), "submission_id").join(said, ["graph_id", "source_utterance"], "left")
    c = c.withColumn("same_id", F.count("*").over(Window.partitionBy("submission_id", "claim_id")))
    literal = casefold(F.trim("text")).eqNullSafe(casefold(F.trim("u_text"))) & (F.col("text") != "")
    good = F.coalesce(literal, F.lit(False)) & (F.col("kind") == "reported_claim") & F.col("world_fact").eqNullSafe(False)
    return _rows(c, "claim_id", {"M23": F.col("same_id") > 1, "M24": ~F.coalesce(good, F.lit(False))}).distinct()


def journal_violations(journal: DataFrame, bindings: DataFrame) -> DataFrame:
    """M25 of a journal (graph_id, revision, operation, submission_id, proposal_id, payload, digest): revisions without a gap from 1, digests of their
    payloads, revocations only of proposals that are known and not retired before, and every binding that was submitted in it."""
    j = journal.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("revision")))
    bad = (F.col("revision") != F.col("place")) | ~F.sha2(F.col("payload").cast("binary"), 256).eqNullSafe(F.col("digest"))
    out = j.where(bad).select("submission_id", F.lit("M25").alias("rule"), F.col("revision").cast("string").alias("subject"))
    each = Window.partitionBy("graph_id", "proposal_id").orderBy("revision").rowsBetween(Window.unboundedPreceding, -1)
    state = j.where("proposal_id IS NOT NULL").withColumn("proposed", F.max(F.col("operation") == "propose").over(each)).withColumn("retired", F.max(F.col("operation") == "revoke").over(each))
    loose = state.where((F.col("operation") == "revoke") & (~F.coalesce("proposed", F.lit(False)) | F.coalesce("retired", F.lit(False))))
    out = out.union(loose.select("submission_id", F.lit("M25"), F.col("revision").cast("string")))
    recorded = j.where("operation = 'propose'").select("submission_id", "proposal_id")
    return out.union(bindings.select("submission_id", "proposal_id").distinct().join(recorded, ["submission_id", "proposal_id"], "left_anti").select("submission_id", F.lit("M25"), "proposal_id")).distinct()


def collisions(s: Submissions) -> DataFrame:
    """M26 between submissions: a submission twice, a proposal of two submissions to one graph, one evidence id with two contents."""
    graph_of = s.packets.select("submission_id", "graph_id").distinct()
    twice = s.packets.groupBy("submission_id").agg(F.count("*").alias("n")).where("n > 1").select("submission_id", F.lit("M26").alias("rule"), F.col("submission_id").alias("subject"))

    def shared(rows: DataFrame, name: str, differs: Column) -> DataFrame:
        of_graph = rows.join(graph_of, "submission_id")
        hit = of_graph.groupBy("graph_id", name).agg(differs.alias("hit")).where("hit").select("graph_id", name)
        return of_graph.join(hit, ["graph_id", name]).select("submission_id", F.lit("M26"), F.col(name).cast("string")).distinct()

    content = F.sha2(F.to_json(F.struct("start", "end", "clip_sha256", "uri")).cast("binary"), 256)
    proposals = shared(s.bindings.select("submission_id", "proposal_id"), "proposal_id", F.min("submission_id") != F.max("submission_id"))
    evidence = shared(s.bundles.select("submission_id", "evidence_id", content.alias("content")), "evidence_id", F.min("content") != F.max("content"))
    return twice.union(proposals).union(evidence)


def violations(s: Submissions, g: Graph, journal: DataFrame | None = None) -> DataFrame:
    """submission_id, rule (M1 to M26) and subject of everything that is wrong; M25 only with a journal."""
    parts = [packet_violations(s, g), bundle_violations(s), binding_violations(s, g), review_violations(s), claim_violations(s, g), collisions(s)]
    parts += [journal_violations(journal, s.bindings)] if journal is not None else []
    return reduce(DataFrame.union, parts).distinct()
