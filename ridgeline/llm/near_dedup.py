"""MinHash near-duplicates by an inverted join on signature coordinates."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.components import components
from . import shingles
from .common import bound, discard, join_split, materialize, table, trimmed

#: Percent of the union that the intersection must reach: in op 2, and in a stage over word shingles.
SIMILAR = 85
STAGE_SIMILAR = 80
#: Coordinates of a signature.
COORDINATES = 64
#: Postings longer than this are served by hubs instead of by all their pairs.
LIGHT = 64

_rng = np.random.default_rng(7)
_TURN = _rng.integers(1, 2**64, COORDINATES, np.uint64)
_TIMES = _rng.integers(1, 2**64, COORDINATES, np.uint64) | np.uint64(1)
_NAME = _rng.integers(1, 2**64, COORDINATES, np.uint64)


def matches(similar: int) -> int:
    """How many coordinates must agree for a pair to be confirmed on full sets.

    At the given similarity, fewer agree less than once in 10 ** 8 pairs: 36 of 64 at 85 percent, 31 at 80.
    """
    s, below = similar / 100, 0.0
    for k in range(COORDINATES + 1):
        below += comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if below > 1e-8:
            return k
    return COORDINATES


def signatures(sets: list) -> np.ndarray:
    """Rows of coordinate-value pairs, each as one number; sets must not be empty."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    if sets:
        held = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        for j in range(COORDINATES):
            out[:, j] = np.minimum.reduceat((held ^ _TURN[j]) * _TIMES[j], starts)
    return shingles.mixed(out ^ _NAME)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, key and signature of each document; no words: n 0, no signature."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingles.sets_of(part.column(1))
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.key_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "key", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n and set of the wanted classes (key, doc_id), from the documents' texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [s for s in shingles.sets_of(batch.column(0).slice(at, 512)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([shingles.key_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "n", "set"])

    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    return texts.mapInArrow(run, "key binary, n long, set array<long>").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _sizes_fit(a: str, b: str, similar: int):
    return (100 * F.col(a) >= similar * F.col(b)) & (100 * F.col(b) >= similar * F.col(a))


def alive(classes: DataFrame, least: int) -> DataFrame:
    """Classes that can have a partner, with their prefix of postings.

    Pairs of coordinate and value that no other class has agree with nobody.
    With the rest ordered by frequency, rare first, two classes that agree in least places
    share one among the first COORDINATES - least + 1 of both.
    """
    tokens = classes.select("key", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    own = join_split(tokens, shared, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("shared"))
    own = own.where(F.size("shared") >= least)
    rest = COORDINATES - least + 1 - (COORDINATES - F.size("shared"))
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda a, x: a + x["freq"])
    own = own.select("key", F.slice("shared", 1, rest).alias("prefix"), weight.alias("weight")).where(F.size("prefix") > 0)
    return own.join(classes.select("key", "n", "sig"), "key")


def _short(sig: np.ndarray) -> np.ndarray:
    return (sig & 0xFF).astype(np.uint8)


def light_pairs(postings: DataFrame, similar: int) -> DataFrame:
    """Pairs within postings of at most LIGHT classes that agree in enough places."""
    least = matches(similar)
    lists = postings.where(F.col("freq") <= LIGHT).groupBy("token").agg(F.collect_list(F.struct("key", "n", "short")).alias("rows")).where(F.size("rows") > 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = [], []
            for rows in batch.column(0).to_pylist():
                rows.sort(key=lambda r: r["key"])
                short = np.frombuffer(b"".join(r["short"] for r in rows), np.uint8).reshape(len(rows), COORDINATES)
                n = np.array([r["n"] for r in rows])
                i, j = np.triu_indices(len(rows), 1)
                ok = (100 * n[i] >= similar * n[j]) & (100 * n[j] >= similar * n[i])
                i, j = i[ok], j[ok]
                ok = (short[i] == short[j]).sum(1) >= least
                left += [rows[k]["key"] for k in i[ok]]
                right += [rows[k]["key"] for k in j[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return lists.select("rows").mapInArrow(run, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("_both", both).where(100 * F.col("_both") >= similar * (F.col("na") + F.col("nb") - F.col("_both"))).select("a", "b")


#: Bits of the bitmaps that bound how many elements two sets share.
BITS = 1024


def bits(xs: Column) -> Column:
    """A bitmap of a set of hashes, as an array of longs."""
    at = F.transform(xs, lambda x: F.pmod(x, F.lit(BITS)).cast("int"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return bound(at, lambda p: F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda w: F.aggregate(F.filter(p, lambda i: F.floor(i / 64) == w), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(one((i % 64).cast("int"))))))


def only(a: str, b: str) -> Column:
    """Bits of one bitmap that the other lacks: at least so many elements of the one set are not in the other."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda t, x: t + x)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def leftover_pairs(heavy: DataFrame, hubs: DataFrame, links: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links of long postings that hubs have not made.

    A class in its hub's component needs no more pairs with the rest of that
    component. For the others, shingles that no other class of long postings
    has bound the intersection with anyone, which leaves few. A class y that is not linked to hub h and a
    class x are similar only if x and y share much of what sets them apart from h: with D(x) the
    symmetric difference of x and h, |D(x) & D(y)| >= (|D(x)| + |D(y)| - (n(x) + n(y)) * (100 - s) / (100 + s)) / 2 at s percent, which
    is over |D(x)| * s / (100 + s) as y is not linked to h. So x is posted under the rarest of D(x), y under all of
    D(y), and the join keeps only pairs that meet the bound, which is similarity itself.
    """
    whole, apart_most = 100 + similar, 100 - similar
    roots = components(links)
    label = F.coalesce(F.col("root"), F.col("key"))
    rows = heavy.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("label", label).select("token", "key", "n", "label")
    each = heavy.select("key").distinct().join(sets, "key").select("key", F.explode("set").alias("shingle"))
    common = each.groupBy("shingle").count().where("count > 1").select("shingle")
    c = each.join(common, "shingle").groupBy("key").agg(F.count("*").alias("c"))
    rows = materialize(rows.join(c, "key"), "heavy")
    hub_label = hubs.select("token", F.col("hub").alias("key")).join(rows, ["token", "key"]).select("token", F.col("label").alias("hub_label"))
    minor = rows.join(hub_label, "token").where("label <> hub_label").drop("hub_label")
    possible = (whole * F.least("c", "c_y") >= similar * (F.col("n") + F.col("n_y"))) & _sizes_fit("n", "n_y", similar)

    def reachable(some: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of some that one of the others in their posting could reach."""
        by_size = others.groupBy("token", F.col("n").alias("n_y")).agg(F.max("c").alias("c_y"))
        held, sizes = some.alias("s"), by_size.alias("b")
        return held.join(sizes, (F.col("s.token") == F.col("b.token")) & possible, "left_semi").select("token", "key", "n", "c", "label")

    late = materialize(reachable(minor, rows), "late")
    near = reachable(rows, late)
    at_hub = hubs.select("token", "hub")
    late, near = (x.join(at_hub, "token").select("hub", "key", "label").distinct() for x in (late, near))
    members = late.withColumn("y", F.lit(1)).withColumn("x", F.lit(0)).union(near.withColumn("y", F.lit(0)).withColumn("x", F.lit(1)))
    members = members.groupBy("hub", "key", "label").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    own = sets.select("key", "n", "set")
    of_hub = sets.select(F.col("key").alias("hub"), F.col("set").alias("hub_set"))
    apart = F.concat(F.array_except("set", "hub_set"), F.transform(F.array_except("hub_set", "set"), F.bitwise_not))
    apart_rows = members = materialize(members.join(own, "key").join(of_hub, "hub").select("x", "y", "hub", "key", "label", "n", apart.alias("d")), "apart")
    posted = materialize(members.select("hub", "key", F.explode("d").alias("e")), "differences")
    shared = posted.groupBy("hub", "e").agg(F.count("*").alias("freq")).where("freq > 1")
    common = posted.join(shared, ["hub", "e"]).groupBy("hub", "key").agg(F.array_sort(F.collect_list(F.struct("freq", "e"))).alias("es"))
    members = materialize(members.join(common, ["hub", "key"]), "shared")
    # Differences that nobody shares are the rarest: they fill the first places of a prefix.
    size, held = F.size("d"), F.size("es")
    first = size - F.greatest(F.floor(size * similar / whole), F.lit(1)) + 1 - (size - held)
    post_x = members.where("x = 1").select("hub", "key", F.explode(F.slice("es", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("p"), "label").select("hub", "key", "label", "p.e")
    post_y = members.where("y = 1").select("hub", "key", F.explode("es").alias("p"), "label").select("hub", "key", "label", "p.e")

    # First the pairs that meet anywhere and that their bitmaps, of fixed size, allow to be alike, each once; only then the differences themselves.
    brief = members.select("hub", "key", "n", F.size("d").alias("size"), bits(F.col("d")).alias("bits"))
    post_x, post_y = (p.join(brief, ["hub", "key"]).select("hub", "e", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "label", "n", "size", "bits")]) for p, side in ((post_x, "x"), (post_y, "y")))
    most = F.least(F.col("size_x") - only("bits_x", "bits_y"), F.col("size_y") - only("bits_y", "bits_x"))
    near_enough = 2 * whole * most >= whole * (F.col("size_x") + F.col("size_y")) - apart_most * (F.col("n_x") + F.col("n_y"))
    meet = post_x.join(post_y, ["hub", "e"]).where((F.col("label_x") != F.col("label_y")) & near_enough).select("hub", "key_x", "key_y").distinct()

    def with_sets(pairs: DataFrame, side: str) -> DataFrame:
        held = members.select("hub", *[F.col(x).alias(f"{x}_{side}") for x in ("key", "n", "d")])
        return pairs.join(held, ["hub", f"key_{side}"])

    alike = 2 * whole * F.size(F.array_intersect("d_x", "d_y")) >= whole * (F.size("d_x") + F.size("d_y")) - apart_most * (F.col("n_x") + F.col("n_y"))
    pairs = with_sets(with_sets(meet, "x"), "y").where(alike).select(F.col("key_x").alias("a"), F.col("key_y").alias("b"))
    out = materialize(_ordered(pairs), "leftover")
    discard(rows, late, apart_rows, posted, members)
    return out


def link(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class. Classes are posted under the
    rarest of their coordinate-value pairs; pairs in short postings are counted over whole signatures
    (merging), long postings are skipped but for a hub each, and what hubs leave is
    found by bounds; all pairs that agree often enough are confirmed on full sets. similar: percent
    of the union that two sets must share.

    Null, empty and blank texts: no shingles, a component of their own. Null
    doc_id: linked by its text, never a component_id unless the whole component has none.
    Repeated rows: equal classes; each row stays. Empty table: empty result. Other
    columns are ignored.
    """
    rows, label = labelled(docs, similar)
    # Copies share a key, which may be hot; rows without words have none and are joined with nothing.
    full = join_split(rows.where("n > 0").select("key", "doc_id", "n"), label.select("key", "component_id"), "key", small=0)
    out = full.select("doc_id", "n", "component_id").union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def labelled(docs: DataFrame, similar: int) -> tuple:
    """What signed() gives of each row, and of each class: key, doc_id (its least), root, component_id."""
    rows = materialize(signed(docs), "signatures")
    full = rows.where("n > 0")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(classes, "classes")
    held = materialize(alive(classes, matches(similar)), "alive")
    postings = held.select("key", "n", "weight", F.unhex(F.array_join(F.transform("sig", lambda x: F.lpad(F.substring(F.hex(x), -2, 2), 2, "0")), "")).alias("short"), F.explode("prefix").alias("p")).select("key", "n", "weight", "short", "p.freq", "p.token")
    heavy = postings.where(F.col("freq") > LIGHT)
    hubs = heavy.groupBy("token").agg(F.max(F.struct("weight", "key", "n")).alias("h")).select("token", F.col("h.key").alias("hub"), F.col("h.n").alias("hub_n"))
    stars = join_split(heavy, hubs, "token").where((F.col("key") != F.col("hub")) & _sizes_fit("n", "hub_n", similar)).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    pairs = materialize(_ordered(light_pairs(postings, similar).union(stars)), "pairs")
    named = classes.select("key", "doc_id")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(heavy.select("key")).distinct()
    sets = materialize(full_sets(docs, named.join(wanted, "key", "left_semi")), "sets")
    links = materialize(confirmed(pairs, sets, similar), "links")
    if not heavy.isEmpty():
        more = leftover_pairs(heavy, hubs, links, sets, similar)
        first, links = links, materialize(links.union(confirmed(more, sets, similar)), "all-links")
        discard(first, more)
    roots = components(links)
    label = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    label = materialize(label, "label")
    discard(classes, held, pairs, sets, links)
    least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, join_split(label, least, "root").select("key", "doc_id", "root", "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with the key of their shingle set as _key; no words: null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = [shingles.key_of(s) if len(s) else None for s in shingles.sets_of(part.column(part.schema.get_field_index("text")))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "_key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_key", BinaryType())]))


def deduplicated(docs: DataFrame, similar: int = STAGE_SIMILAR) -> DataFrame:
    """The documents with one row of each component left, columns as they were.

    The row is chosen by shingle set and doc_id: the one with the least doc_id of its
    component, one without only where the whole component has none. Rows of one doc_id, or of
    none, are as different as their texts. Those without words are each a component of their own and stay.
    """
    _, label = labelled(docs, similar)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")
    chosen = label.groupBy("root").agg(first).select(F.col("r.key").alias("_chosen"), F.col("r.doc_id").alias("_id"))
    same = (F.col("_key") == F.col("_chosen")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    one = keyed(docs).join(chosen, same, "left_semi").dropDuplicates(["_key"])
    return one.select(*docs.columns).union(docs.where(trimmed(F.col("text")) == ""))


def op2_minhash_dedup(spark, sf_dir):
    """Near-duplicates among all documents."""
    return link(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and reachability; doc_id is taken to be unique.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) u(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b FROM reach r JOIN links ON r.other = links.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.doc_id
"""
