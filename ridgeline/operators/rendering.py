"""Facts as lines of text, the windows of a page, and reviews of names.

Facts here: fact_id, t0, t1 (seconds), win (from 1), kind, carrier, predicate, value, dropped, reason, flags
(array of strings) and roles (array of role, entity, description).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_words, mmss


def segments(roles: Column) -> Column:
    """Roles merged by entity and description, in order of first sight: array of (names, entity, description)."""
    keys = F.array_distinct(F.transform(roles, lambda r: F.struct(r["entity"].alias("entity"), r["description"].alias("description"))))
    names = lambda k: F.array_join(F.transform(F.filter(roles, lambda r: r["entity"].eqNullSafe(k["entity"]) & r["description"].eqNullSafe(k["description"])), lambda r: r["role"]), ",")
    return F.coalesce(F.transform(keys, lambda k: F.struct(names(k).alias("names"), k["entity"].alias("entity"), k["description"].alias("description"))), F.array())


def _held(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _segment(s: Column, width: int, show: Column) -> Column:
    described = F.when(_held(s["description"]) & F.lit(width > 0) & show, F.concat(F.lit(' "'), cut_words(s["description"], width), F.lit('"'))).otherwise("")
    return F.concat(s["names"], F.lit("="), F.when(_held(s["entity"]), s["entity"]).otherwise("?"), described)


def _line(parts: Column) -> Column:
    later = F.when(F.col("t0").eqNullSafe(F.col("t1")), "").otherwise(F.concat(F.lit("–"), mmss(F.col("t1"))))
    window = F.when(F.coalesce("win", F.lit(0)) != 0, F.concat(F.lit(" W"), F.col("win").cast("string"))).otherwise("")
    carrier = F.when((F.col("kind") == "text") & _held(F.col("carrier")), F.concat(F.lit("("), F.col("carrier"), F.lit(")"))).otherwise("")
    value = F.when(_held(F.col("value")), F.concat(F.lit(' = "'), F.col("value"), F.lit('"'))).otherwise("")
    flags = F.coalesce(F.array_sort("flags"), F.array().cast("array<string>"))
    extra = F.when(F.size(flags) > 0, F.concat(F.lit(" | ⚠ "), F.array_join(flags, ", "))).otherwise("")
    reason = F.when(F.coalesce("dropped", F.lit(False)), F.concat(F.lit(" | reason="), F.coalesce("reason", F.lit("None")))).otherwise("")
    return F.concat("fact_id", F.lit(" ["), mmss(F.col("t0")), later, F.lit("]"), window, F.lit(" "), "kind", carrier, F.lit(' "'), F.coalesce("predicate", F.lit("")), F.lit('"'), value, F.lit(" | "), F.array_join(parts, " ; "), extra, reason)


def rendered(facts: DataFrame, width: int = 70) -> DataFrame:
    """fact_id and line of each fact, every description shown, cut to width at a blank; width 0: none."""
    return facts.select("fact_id", _line(F.transform(segments(F.col("roles")), lambda s: _segment(s, width, F.lit(True)))).alias("line"))


def rendered_page(page: DataFrame, order: list, width: int = 70) -> DataFrame:
    """fact_id and line of a page, in which each entity of a window is described once, in its first line.

    Entities without an id are described each time. A page is short: its lines are numbered in one task.
    """
    lines = page.withColumn("_line", F.row_number().over(Window.orderBy(*order)))
    each = lines.select("_line", "win", F.posexplode(segments(F.col("roles"))).alias("_pos", "_s"))
    place = F.row_number().over(Window.partitionBy(F.col("_s.entity"), "win").orderBy("_line", "_pos"))
    each = each.withColumn("_show", (place == 1) | ~_held(F.col("_s.entity")))
    part = F.struct("_pos", _segment(F.col("_s"), width, F.col("_show")).alias("text"))
    parts = each.groupBy("_line").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    found = F.coalesce(F.transform("_parts", lambda x: x["text"]), F.array().cast("array<string>"))
    return lines.join(parts, "_line", "left").orderBy("_line").select("fact_id", _line(found).alias("line"))


def window_view(facts: DataFrame, page: DataFrame, most: int = 6) -> DataFrame:
    """All facts of the first windows of a page, the page's own marked: the facts' columns and matched. Null windows have no view."""
    shown = page.where("win IS NOT NULL").select("win").distinct().orderBy("win").limit(most)
    hits = page.select("fact_id").distinct().withColumn("matched", F.lit(True))
    return facts.join(F.broadcast(shown), "win").join(hits, "fact_id", "left").select(*facts.columns, F.coalesce("matched", F.lit(False)).alias("matched"))


CHECKS = ("name_is_person", "names_this_person", "owner_distinguished", "not_brand_or_program")


def reviewed_names(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mentions (mention_id, source_fact_digest, person_instance, evidence_ids, status) with status and reason after review.

    The last review (revision) of a mention counts. It accepts one that is not rejected if it is of the same
    fact and person, blind, supported, says yes to all checks, names its request and model, and cites some evidence, all
    of it the mention's own and shown. Null anywhere in a condition: it fails. Null mention_id: never reviewed.
    """
    names = ["source_fact_digest", "person_instance", "query_blind", "verdict", *CHECKS, "evidence_ids", "shown_media_ids", "request_sha256", "model"]
    last = reviews.groupBy("mention_id").agg(F.max_by(F.struct(*names), F.struct("revision", "request_sha256", "verdict")).alias("r"))
    cited = F.col("r.evidence_ids")
    within = lambda c: F.size(F.array_except(cited, c)) == 0
    good = (F.col("r.source_fact_digest") == F.col("source_fact_digest")) & (F.col("r.person_instance") == F.col("person_instance")) & F.col("r.query_blind") & (F.col("r.verdict") == "supported")
    for check in CHECKS:
        good = good & F.col(f"r.{check}")
    good = good & (F.size(cited) > 0) & within(F.col("evidence_ids")) & within(F.col("r.shown_media_ids")) & _held(F.col("r.request_sha256")) & _held(F.col("r.model"))
    accepted = F.coalesce(good & (F.col("status") != "rejected"), F.lit(False))
    held = mentions.join(last, "mention_id", "left")
    return held.select(*[F.col(c) for c in mentions.columns if c != "status"], F.when(accepted, "accepted").otherwise(F.col("status")).alias("status"), F.when(accepted, "local_visual_name_review").alias("reason"))
