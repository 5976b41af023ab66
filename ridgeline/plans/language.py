"""Queries of text functions: terms, keys, spellings, names, numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.adapters import UTTERANCES, read, utterances


def alignment_terms(spark, sf_dir):
    return utterances(spark, sf_dir).select("utterance_id", F.array_join(text.alignment_terms(F.col("text")), " ").alias("terms"))


def phonetic_key(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", text.phonetic_key(F.col("token")).alias("key"))


def _tokens(spark, sf_dir):
    """Distinct capitalised Latin words of the conversations."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    return utterances(spark, sf_dir).select(found.alias("token")).where(F.col("token").rlike("^[A-Z][a-z]{3,}$")).distinct()


def fuzzy_spelling(spark, sf_dir):
    """Each word of the conversations with the capitalised word it stands for: the same one but for case, else the nearest by phonetic key, the first in order."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Za-z][A-Za-z'\-]{2,}\b"), F.lit(0)))
    spoken = utterances(spark, sf_dir).select(found.alias("token")).distinct()
    words = _tokens(spark, sf_dir).select(F.col("token").alias("other"))
    exact = spoken.join(words, F.lower("token") == F.lower("other")).groupBy("token").agg(F.min("other").alias("other"))
    exact = exact.select("token", "other", F.lit("exact").alias("match"), F.lit(0).cast("long").alias("distance"))
    left, right = (d.withColumn("key", text.phonetic_key(F.col(c))).where(F.char_length("key") >= 3) for d, c in ((spoken, "token"), (words, "other")))
    near = _near_keys(left.select("key").distinct(), right.select("key").distinct())
    pairs = left.withColumnRenamed("key", "a").join(near, "a").join(right.withColumnRenamed("key", "b"), "b").join(exact.select("token"), "token", "left_anti")
    best = pairs.groupBy("token").agg(F.min(F.struct("distance", "other")).alias("r"))
    return exact.union(best.select("token", "r.other", F.lit("phonetic"), "r.distance"))


def _near_keys(a, b):
    """a, b, distance of all keys within max(1, a third of the shorter one's length).

    Of d + 1 pieces of the shorter key one stands whole in the longer one, at most d places
    off; so keys join on pieces and where they come from, and no pair is left out.
    """
    d = lambda n: F.greatest(F.floor(n / 3).cast("int"), F.lit(1))
    size = F.char_length("key")

    def pieces(keys):
        """As the shorter one: its length, the piece's number, the piece."""
        many = d(size) + 1
        at = keys.select("key", size.alias("n"), many.alias("many"), F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
        start = lambda i: F.floor(i * F.col("n") / F.col("many")).cast("int")
        return at.select("key", "n", "i", F.substring("key", start(F.col("i")) + 1, start(F.col("i") + 1) - start(F.col("i"))).alias("piece"))

    def windows(keys):
        """As the longer one: every length the shorter one can have, with all places its pieces can stand at."""
        n = keys.select("key", size.alias("size"), F.explode(F.sequence(F.greatest(F.lit(3), F.floor(size / 2).cast("int") - 1), size)).alias("n")).where(F.col("size") - F.col("n") <= d(F.col("n")))
        at = n.withColumn("many", d(F.col("n")) + 1).select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i"))
        start = lambda i: F.floor(i * F.col("n") / F.col("many")).cast("int")
        long = start(F.col("i") + 1) - start(F.col("i"))
        place = F.explode(F.sequence(F.greatest(start(F.col("i")) - F.col("many") + 1, F.lit(0)), start(F.col("i")) + F.col("many") - 1))
        at = at.select("key", "size", "n", "i", long.alias("long"), place.alias("place")).where(F.col("place") + F.col("long") <= F.col("size"))
        return at.select("key", "n", "i", F.substring("key", F.col("place") + 1, F.col("long")).alias("piece")).distinct()

    join = ["n", "i", "piece"]
    one = pieces(a.select("key")).withColumnRenamed("key", "a").join(windows(b).withColumnRenamed("key", "b"), join).select("a", "b")
    two = windows(a).withColumnRenamed("key", "a").join(pieces(b.select("key")).withColumnRenamed("key", "b"), join).select("a", "b")
    both = one.union(two).distinct().withColumn("distance", F.levenshtein("a", "b").cast("long"))
    return both.where(F.col("distance") <= d(F.least(F.char_length("a"), F.char_length("b"))))


def identifiers(spark, sf_dir):
    """Of every whole document, after a few planted ones; a null id or text takes nothing else away."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("vest No. 0"), part("doc_id"), F.lit(" and number 007, # 12 "), part("text")).alias("t"))
    return d.select("doc_id", F.array_join(text.identifiers(F.col("t")), ",").alias("ids"))


def parsed_times(spark, sf_dir):
    """Turns written as h:mm:ss, mm:ss or seconds, and read again."""
    n = F.col("doc_id")
    written = F.when(n % 3 == 0, F.concat_ws(":", F.lit("1"), (n % 60).cast("string"), F.lit("05"))).when(n % 3 == 1, F.concat_ws(":", (n % 60).cast("string"), F.lit("30.5"))).otherwise(F.lit("x"))
    return read(spark, sf_dir, "documents").select("doc_id", text.parse_time(written).alias("seconds"), text.mmss((n * 7).cast("double")).alias("shown"))


def norm_phrases(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_phrase(F.col("text")).cast("binary")).alias("digest"))


def person_name_shape(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Anna Lee "), "c_mktsegment")).otherwise(F.col("c_name")).alias("name"))
    return c.select("key", "name", text.is_person_name(F.col("name")).alias("is_name"))


def retrieval_text(spark, sf_dir):
    """Non-empty parts joined and cut."""
    p = read(spark, sf_dir, "part")
    parts = F.filter(F.array("p_name", F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_brand")), "p_type"), lambda x: x != "")
    return p.select("p_partkey", F.substring(F.array_join(parts, " ; "), 1, 40).alias("text"))


def embedding_cache_misses(spark, sf_dir):
    """Texts by digest that a cache of every third document lacks, with how many share them."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("key"))
    cache = d.where("doc_id % 3 = 0").select("key").distinct()
    return d.join(cache, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def named_mentions(spark, sf_dir):
    """Two-word names of a conversation with their place and how often they occur up to there."""
    u = utterances(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), F.lit(1))).alias("place", "name"))
    w = Window.partitionBy("conv_id", "name").orderBy("turn", "place")
    return u.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "name", F.row_number().over(w).cast("long").alias("nth"))


def name_registry(spark, sf_dir):
    """First words of turns as names of their speaker: kept where a speaker has one name only, by lower case."""
    u = utterances(spark, sf_dir).select("speaker", F.regexp_extract("text", r"^([A-Za-z]+)", 1).alias("name"), "turn").where("name <> ''")
    n = F.size(F.collect_set(F.lower("name")).over(Window.partitionBy("speaker")))
    return u.withColumn("n", n).where("n = 1").groupBy("speaker").agg(F.min("name").alias("name"), F.count("*").alias("mentions"))


def caption_name_match(spark, sf_dir):
    """Captions about a nation in several forms: which of them state its name as a person's."""
    n = read(spark, sf_dir, "nation")
    name = F.col("n_name")
    forms = [F.concat(F.lit("her name tag reads \""), name, F.lit("\"")), F.concat(F.lit("someone named "), F.lower(name), F.lit(" waves")), F.concat(F.lit("this is "), name, F.lit(".")), F.concat(F.lit("named "), name, F.lit("-like")), F.concat(F.lit("identified as '"), name, F.lit("' twice"))]
    caption = F.element_at(F.array(*forms), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select("n_nationkey", text.states_name(caption, name).alias("named"))


def verdict_contradictions(spark, sf_dir):
    """Reviews whose reasons contradict their verdicts, and what they say."""
    b = read(spark, sf_dir, "benchmark")
    reasons = ("clearly a different person", "they are the same, no doubt", "not the same, though the same person was there", "same child", "different people", "a different car")
    reason = F.element_at(F.array(*[F.lit(r) for r in reasons], F.col("text")), (F.col("item_id") % 7 + 1).cast("int"))
    verdict = F.when(F.col("item_id") % 2 == 0, "same").otherwise("different")
    return b.select("item_id", F.coalesce(text.contradicted(verdict, reason), F.lit("")).alias("finding"))


_STOP = """('about', 'after', 'again', 'also', 'back', 'been', 'before', 'being', 'does', 'doing', 'done', 'from', 'going', 'gonna', 'have', 'here', 'into', 'just', 'like', 'little', 'make', 'more', 'much',
  'really', 'right', 'some', 'that', 'them', 'then', 'there', 'these', 'they', 'this', 'those', 'very', 'want', 'what', 'when', 'where', 'which', 'while', 'will', 'with', 'your')"""

QUERIES = [
    ("alignment_terms", alignment_terms, f"""WITH {UTTERANCES}, w AS (SELECT utterance_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM utterances_v),
k AS (SELECT DISTINCT utterance_id, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM w WHERE length(w) >= 4 AND w NOT IN {_STOP})
SELECT utterance_id, coalesce(array_to_string(list_sort(list(k.w) FILTER (k.w IS NOT NULL)), ' '), '') AS terms FROM utterances_v LEFT JOIN k USING (utterance_id) GROUP BY 1"""),
    ("phonetic_key", phonetic_key, None),
    ("fuzzy_spelling", fuzzy_spelling, None),
    ("identifiers", identifiers, None),
    ("parsed_times", parsed_times, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3600.0::DOUBLE + (doc_id % 60) * 60 + 5 WHEN doc_id % 3 = 1 THEN (doc_id % 60) * 60 + 30.5::DOUBLE END AS seconds, ((doc_id * 7) // 60) || ':' || lpad(CAST((doc_id * 7) % 60 AS VARCHAR), 2, '0') || '.0' AS shown FROM documents"),
    ("norm_phrases", norm_phrases, "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents"),
    ("person_name_shape", person_name_shape, "WITH c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'Anna Lee ' || c_mktsegment ELSE c_name END AS name FROM customer) SELECT key, name, length(name) <= 48 AND regexp_matches(name, '^\\p{L}+([''’-]\\p{L}+)*( \\p{L}+([''’-]\\p{L}+)*){0,3}$') AS is_name FROM c"),
    ("retrieval_text", retrieval_text, "SELECT p_partkey, substr(p_name || CASE WHEN p_size > 25 THEN '' ELSE ' ; ' || p_brand END || ' ; ' || p_type, 1, 40) AS text FROM part"),
    ("embedding_cache_misses", embedding_cache_misses, "WITH d AS (SELECT doc_id, sha1(text) AS key FROM documents) SELECT key, count(*) AS n, min(doc_id) AS first FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 3 = 0) GROUP BY 1"),
    ("named_mentions", named_mentions, None),
    ("name_registry", name_registry, f"WITH {UTTERANCES}, n AS (SELECT speaker, regexp_extract(text, '^([A-Za-z]+)', 1) AS name FROM utterances_v) SELECT speaker, min(name) AS name, count(*) AS mentions FROM n WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT lower(name)) = 1"),
    ("caption_name_match", caption_name_match, "SELECT n_nationkey, n_nationkey % 5 IN (0, 1, 4) AS named FROM nation"),
    ("verdict_contradictions", verdict_contradictions, """SELECT item_id, CASE WHEN item_id % 2 = 0 AND (item_id % 7 IN (0, 2, 4) OR (item_id % 7 = 6 AND d AND NOT s)) THEN 'different' WHEN item_id % 2 = 1 AND (item_id % 7 IN (1, 3) OR (item_id % 7 = 6 AND s AND NOT d)) THEN 'same' ELSE '' END AS finding
FROM (SELECT item_id, regexp_matches(lower(text), 'different (person|people|individual|individuals|woman|man)([^a-z]|$)|not the same') AS d, NOT contains(lower(text), 'not the same') AND regexp_matches(lower(text), '(is|are) the same|same (person|woman|man|individual|girl|boy|child)([^a-z]|$)') AS s FROM benchmark)"""),
]
