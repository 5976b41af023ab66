"""Scoped retrieval over a facts table: filters, deduplication, ranking, pages, facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot
from ..functions.text import keyword_match, norm_phrase, role_group, seconds

#: Named periods as fractions of the duration.
PERIODS = {
    "beginning": (0, 0.1), "end": (0.9, 1),
    "first_half": (0, 0.5), "second_half": (0.5, 1),
    "first_third": (0, 1 / 3), "middle_third": (1 / 3, 2 / 3), "last_third": (2 / 3, 1),
    "first_quarter": (0, 0.25), "second_quarter": (0.25, 0.5), "third_quarter": (0.5, 0.75), "last_quarter": (0.75, 1),
}
KINDS = ("event", "state", "attribute", "text", "speech")
SORTS = ("relevance", "time_asc", "time_desc")


def resolve_time(duration: float, start=None, end=None, around=None, tolerance=15, period=None, segment=None) -> tuple:
    """All given bounds on time intersected, as (low, high); None is open.

    An unknown period or a segment k/n outside 1..n is no bound; tolerance 0 is 15.
    """
    low, high = [], []
    if seconds(start) is not None:
        low.append(seconds(start))
    if seconds(end) is not None:
        high.append(seconds(end))
    if seconds(around) is not None:
        low.append(max(0, seconds(around) - (tolerance or 15)))
        high.append(seconds(around) + (tolerance or 15))
    if period in PERIODS:
        a, b = PERIODS[period]
        low.append(a * duration)
        high.append(b * duration)
    m = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", segment or "")
    if m and 1 <= int(m[1]) <= int(m[2]):
        k, n = int(m[1]), int(m[2])
        low.append((k - 1) / n * duration)
        high.append(k / n * duration)
    return max(low, default=None), min(high, default=None)


@dataclass
class Search:
    """A query: every field that is set is one more condition."""

    ids: tuple = ()
    kinds: tuple = ()
    windows: tuple = ()
    start: float | None = None
    end: float | None = None
    predicate: str = ""
    value: str = ""
    roles: dict = field(default_factory=dict)
    sort: str = "time_asc"
    limit: int = 10
    offset: int = 0

    def __post_init__(self):
        wrong = [k for k in self.kinds if k not in KINDS]
        if wrong or self.sort not in SORTS:
            raise ValueError(f"unknown kind or sort: {wrong or self.sort}")
        self.ids = tuple(str(i).upper() for i in self.ids)
        self.windows = tuple(int(re.sub(r"[^0-9]", "", str(w))) for w in self.windows)
        self.limit = max(1, min(100, self.limit))


def slot(roles: Column, name: str, filler) -> Column:
    """Whether some role (role, entity, description) of a fact fills a slot.

    name: a role, a group such as @target, or *. filler: None, ? or * for
    filled at all; a list of ids; one id; else keywords on the description.
    """

    def fits(r: Column) -> Column:
        at = F.lit(True) if name == "*" else (role_group(r["role"]) == name) if name.startswith("@") else (F.lower(r["role"]) == name.lower())
        if filler in (None, "?", "*"):
            return at
        if isinstance(filler, (list, tuple)):
            return at & r["entity"].isin(*[str(x).upper() for x in filler])
        if re.fullmatch(r"[PORVporv]\d+", filler):
            return at & (r["entity"] == filler.upper())
        return at & keyword_match(r["description"], filler)

    return F.exists(roles, fits)


def condition(q: Search) -> Column:
    """All filters as one predicate, so that what a scan can take is pushed down to it."""
    out = F.lit(True)
    if q.ids:
        out = out & F.col("fact_id").isin(*q.ids)
    if q.kinds:
        out = out & F.col("kind").isin(*q.kinds)
    if q.windows:
        out = out & F.col("win").isin(*q.windows)
    if q.start is not None:
        out = out & (F.col("t1") >= q.start)
    if q.end is not None:
        out = out & (F.col("t0") <= q.end)
    if q.predicate:
        out = out & keyword_match(F.col("predicate"), q.predicate)
    if q.value:
        out = out & keyword_match(F.col("value"), q.value)
    for name, filler in q.roles.items():
        out = out & slot(F.col("roles"), name, filler)
    return out


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def pool(facts: DataFrame, q: Search, include_dropped: bool = False) -> DataFrame:
    """The facts a search ranges over: never quarantined ones; dropped ones only where asked for, or by id. Null flags are false."""
    held = facts.where(condition(q) & ~_flag("quarantined"))
    return held if include_dropped or q.ids else held.where(~_flag("dropped"))


def left_out(facts: DataFrame, q: Search, include_dropped: bool = False) -> DataFrame:
    """One row: how many facts that meet the conditions are left out as dropped, and as quarantined."""
    dropped = F.lit(not (include_dropped or q.ids)) & _flag("dropped") & ~_flag("quarantined")
    return facts.where(condition(q)).agg(F.count_if(dropped).alias("dropped"), F.count_if(_flag("quarantined")).alias("quarantined"))


def deduplicated(facts: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in that order, with the number of rows as multiplicity. Null windows are one key."""
    w = Window.partitionBy(*key)
    counted = facts.withColumn("multiplicity", F.count("*").over(w))
    return counted.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n")


def fact_key() -> list:
    return ["win", norm_phrase(F.col("predicate")), "agent", "object"]


def paged(facts: DataFrame, q: Search) -> DataFrame:
    """Sorted and cut to the page; null times go last upwards and count as 0 downwards.

    relevance: by the column sim, the best first, then by time; where there is no such column, as there is no query, by time.
    """
    order = [F.coalesce("t0", F.lit(0)).desc(), F.col("fact_id").asc()] if q.sort == "time_desc" else [F.col("t0").asc_nulls_last(), F.col("fact_id").asc()]
    if q.sort == "relevance" and "sim" in facts.columns:
        order = [F.col("sim").desc_nulls_last(), *order]
    return facts.orderBy(*order).offset(q.offset).limit(q.limit)


def search(facts: DataFrame, q: Search) -> DataFrame:
    """Filter, deduplicate, sort, page, in that order."""
    return paged(deduplicated(facts.where(condition(q)), fact_key(), ["t0", "fact_id"]), q)


def similar(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Vectors with their similarity to the one query vector: a broadcast of one row."""
    one = query.select(F.col("embedding").alias("_q")).limit(1)
    return vectors.join(F.broadcast(one)).withColumn("sim", dot(F.col("embedding"), F.col("_q"))).drop("_q")


def relative_cut(scored: DataFrame, width: float = 0.15) -> DataFrame:
    """Those within a width of the best similarity; the best is one aggregate, joined back as one row."""
    best = scored.agg(F.max("sim").alias("_best"))
    return scored.join(F.broadcast(best)).where(F.col("sim") >= F.col("_best") - width).drop("_best")


def facets(facts: DataFrame, top: int = 8) -> DataFrame:
    """Entities, predicates of events, roles and windows by count: facet, item, n, rank. Ties: first seen."""
    seen = F.struct("t0", "fact_id")

    def item(facet: str, value) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("item"))

    items = [item("entity", F.col("agent")), item("entity", F.col("object")), F.when(F.col("kind") == "event", item("predicate", F.col("predicate")))]
    items += [item("role", F.lit("agent")), item("role", F.lit("patient")), item("window", F.concat(F.lit("W"), F.col("win").cast("string")))]
    rows = facts.select(seen.alias("seen"), F.inline(F.array_compact(F.array(*items))))
    counted = rows.groupBy("facet", "item").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "seen", "item"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("facet", "item", "n", "rank")


def empty_windows(windows: DataFrame, facts: DataFrame, low: int, high: int) -> DataFrame:
    """Windows that overlap a range strictly and hold no fact."""
    return windows.where((F.col("end") > low) & (F.col("start") < high)).join(facts.select("win").distinct(), "win", "left_anti")


def expanded(facts: DataFrame, hits: DataFrame, mode: str, cap: int = 12) -> DataFrame:
    """Facts that go with each hit: hit, fact_id, rank.

    window: same window. participants: same window and a shared agent or object.
    closure: those participants that are texts, states or attributes. The first
    cap by time; a join on the window, never over all pairs.
    """
    h = hits.select(F.col("fact_id").alias("hit"), "win", F.col("agent").alias("_a"), F.col("object").alias("_o"))
    both = facts.join(h, "win").where(F.col("fact_id") != F.col("hit"))
    if mode in ("participants", "closure"):
        both = both.where((F.col("agent") == F.col("_a")) | (F.col("object") == F.col("_o")))
    if mode == "closure":
        both = both.where(F.col("kind").isin("text", "state", "attribute"))
    rank = F.row_number().over(Window.partitionBy("hit").orderBy(F.coalesce("t0", F.lit(0)), "fact_id"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap).select("hit", "fact_id", "rank")
