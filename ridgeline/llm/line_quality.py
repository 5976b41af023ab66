"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound, fixed, guarded, table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Boilerplate phrases, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "sign up for our newsletter", "subscribe to our newsletter", "enable javascript", "javascript is disabled",
    "your browser does not support", "skip to content", "back to top", "lorem ipsum", "powered by wordpress",
    "share on facebook", "share on twitter", "add to cart", "we use cookies", "accept cookies", "page not found",
)
#: Words of navigation lines.
NAVIGATION = (
    "about", "account", "archive", "blog", "cart", "contact", "faq", "forum", "help", "home", "index", "login", "logout",
    "menu", "next", "page", "prev", "previous", "privacy", "register", "search", "shop", "sitemap", "terms",
)

DEFAULTS = {
    "symbol_percent": 3,  # symbols of [#*$%&|<>] per 100 characters of a line, at most
    "separator_percent": 20,  # words that are only separators per 100 words of a line, at most
    "shout_percent": 60,  # words that end in !! or ?? per 100 words of a line, at most
    "upper_percent": 60,  # upper-case letters per 100 letters of a line, at most
    "navigation_percent": 80,  # navigation words per 100 words of a line, at most
    "lost_percent": 30,  # characters of words in removed lines per 100, at most, for a document to be kept
}


def line_fails(line: Column, p: dict) -> Column:
    """Whether a line fails a rule: punctuation, navigation or boilerplate. Blank lines pass."""
    tidy = F.concat(F.lit(" "), F.regexp_replace(line, f"[{SPACE}]+", "  "), F.lit(" "))

    def judged(x: Column) -> Column:
        count = F.size(F.split(x, "  "))
        solid = F.char_length(F.replace(x, F.lit(" "), F.lit("")))
        lower = F.lower(x)
        upper, letters = F.regexp_count(x, F.lit(r"\p{Lu}")), F.regexp_count(x, F.lit(r"\p{L}"))
        failed = 100 * F.regexp_count(x, F.lit("[#*$%&|<>]")) > p["symbol_percent"] * solid
        failed = failed | (100 * F.regexp_count(x, F.lit(r" [|>»«•·/\\–—*_=~-]{1,3} ")) > p["separator_percent"] * count)
        failed = failed | (100 * F.regexp_count(x, F.lit(r"[!?]{2,} ")) > p["shout_percent"] * count)
        # Capitals: most letters are none, so the costly count is made only where two meet.
        failed = failed | (F.regexp_like(x, F.lit(r"\p{Lu}\p{Lu}")) & (letters >= 8) & (100 * upper > p["upper_percent"] * letters))
        failed = failed | (100 * F.regexp_count(lower, F.lit(rf" (?:{'|'.join(NAVIGATION)})[,:]? ")) > p["navigation_percent"] * count)
        failed = failed | ((count <= 30) & F.regexp_like(lower, F.lit("|".join(BOILERPLATE).replace(" ", " +"))))
        return (solid > 0) & failed

    return bound(tidy, judged)


def repeat_words(ws: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the array, the first included.

    Words are hashed once, windows compared by the hash of eight hashes; only where two agree are the
    windows themselves sorted and compared, so the count is exact.
    """
    n = F.size(ws)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = bound(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def exact(placed: Column) -> Column:
        last = F.size(placed)

        def same(k: Column, other: Column) -> Column:
            return (other >= 1) & (other <= last) & (F.get(placed, k - 1)["w"] == F.get(placed, other - 1)["w"])

        found = F.filter(F.transform(F.sequence(F.lit(1), last), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(placed, k - 1)["i"])), lambda x: x.isNotNull())
        covered = F.aggregate(
            F.array_sort(found),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        )
        return covered["n"]

    def sort_windows() -> Column:
        return F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(ws, i, WINDOW), " ").alias("w"), i.alias("i"))))

    once = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(sort_windows(), exact)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(once).cast("long")


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "lost_chars", "kept")


def judge(docs: DataFrame, clean: bool = True, **parameters) -> DataFrame:
    """Adds to each document the base counts, the verdict and, if clean, the cleaned text.

    Lines are judged first: those that fail a rule of punctuation (symbols,
    shouting, capitals), navigation (separators, menu words) or boilerplate are
    removed. A document is rejected if its base rules fail or if the removed lines held
    more than lost_percent of its word characters.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_bad_lines, lost_chars, kept and clean_text. All are computed row by
    row from the whole text, each line once, without a shuffle.

    Null text: as empty; no words, so base_failed. Ties and repeated rows: rows
    as they stand. Empty table: empty result. Other columns stay; those with the names of added
    ones are replaced, inner names clash with none.
    """
    p = DEFAULTS | parameters
    plain, back = guarded(docs, ("text",))
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.regexp_replace(text, f"[{SPACE}]+", "")
    has_word = F.lit(f"[^{SPACE}]")
    d = fixed(plain, {"words__": words(F.col("text")), "lines__": F.split(text, "\n")})
    full = F.filter("lines__", lambda x: F.regexp_like(x, has_word))
    d = fixed(
        d,
        {
            "n_words": F.size("words__").cast("long"),
            "word_chars": F.char_length(solid).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": bound(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": repeat_words(F.col("words__")),
            "judged__": F.transform("lines__", lambda x: F.struct(x.alias("line"), line_fails(x, p).alias("bad"))),
        },
    )
    bad = F.filter("judged__", lambda x: x["bad"])
    held = F.filter("judged__", lambda x: ~x["bad"])
    lost = bound(bad, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.char_length(F.regexp_replace(F.array_join(F.transform(x, lambda y: y["line"]), ""), f"[{SPACE}]+", "")).cast("long").alias("chars")))
    d = fixed(d, {"lost__": lost})
    d = d.withColumn("n_bad_lines", F.col("lost__.n")).withColumn("lost_chars", F.col("lost__.chars"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= p["lost_percent"] * F.col("word_chars")))
    if clean:
        d = d.withColumn("clean_text", F.when(F.col("n_bad_lines") == 0, text).otherwise(F.array_join(F.transform(held, lambda x: x["line"]), "\n")))
    return back(d, (*ADDED, "clean_text") if clean else ADDED)


def op4_line_quality(spark, sf_dir):
    """Quality rules over every whole document."""
    out = judge(table(spark, sf_dir, "documents"), clean=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_chars")


def _oracle() -> str:
    """The same rules as DuckDB SQL, from the same lists and limits."""
    p, ws = DEFAULTS, "[\\x20\\x09-\\x0D]+"
    count = lambda pattern, x="x": f"len(regexp_extract_all({x}, '{pattern}'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) u(i)),
dup AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM dup, unnest(range(i, i + {WINDOW})) v(j) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
x AS (SELECT r, line, regexp_replace(line, '{ws}', '', 'g') AS s, ' ' || regexp_replace(line, '{ws}', '  ', 'g') || ' ' AS x FROM l),
y AS (SELECT *, len(string_split(x, '  ')) AS n, length(replace(x, ' ', '')) AS solid, lower(x) AS lo FROM x),
bad AS (SELECT r, count(*) AS n, sum(length(s)) AS lost FROM y WHERE solid > 0 AND (
    100 * {count('[#*$%&|<>]')} > {p['symbol_percent']} * solid
    OR 100 * {count(' [|>»«•·/\\\\–—*_=~-]{1,3} ')} > {p['separator_percent']} * n
    OR 100 * {count('[!?]{2,} ')} > {p['shout_percent']} * n
    OR (regexp_matches(x, '\\p{{Lu}}\\p{{Lu}}') AND {count('\\p{L}')} >= 8 AND 100 * {count('\\p{Lu}')} > {p['upper_percent']} * {count('\\p{L}')})
    OR 100 * {count(' (?:' + '|'.join(NAVIGATION) + ')[,:]? ', 'lo')} > {p['navigation_percent']} * n
    OR (n <= 30 AND regexp_matches(lo, '{'|'.join(BOILERPLATE).replace(' ', ' +')}'))) GROUP BY r),
b AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{ws}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda q: regexp_matches(q, '[^\\x20\\x09-\\x0D]')) AS solid_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(bad.n, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(bad.lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN bad ON d.r = bad.r),
c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(solid_lines) - len(list_distinct(solid_lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {p['lost_percent']} * word_chars AS kept, n_bad_lines, lost_chars FROM c
"""


ORACLE = _oracle()
