"""Personal data: base patterns, and candidates judged by boosted trees, in DataFrame functions only."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import Model, train
from .common import bound, fixed, guarded, table

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Starts within a run of the first class can't
#: match where the run's own start does not, but right after a match they can
#: (\\G); with that and possessive groups each text is read once, whatever its runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Generators of candidates, by the kind of their spans; they overlap.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z.,+])(?:\+|00)?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])",
    "hidden_email": r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._-]{1,40} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{2,40}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{2,20}){1,3}(?![a-z0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){3,7}:?[0-9a-f]{1,4}(?![0-9a-z:])",
    "date": r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}[\p{L}'-]{1,30}(?: \p{Lu}[\p{L}'-]{1,30}){0,2}",
}
#: A text without this has no candidate of the generator.
GENERATOR_GATES = {
    "number": r"[0-9](?:[ ().-]{0,2}[0-9]){6}",
    "hidden_email": r"(?i)\(at\)|\[at\]| at .{1,60}(?: dot |\(dot\)|\[dot\])",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "ipv6": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]{1,4}:",
    "date": r"[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-",
    "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}",
}

CONTEXT_CHARS = 40
#: Words before a candidate, by what they speak for, in English, German, French and Spanish.
CONTEXT = {
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|contact|reach|telefon|handy|anruf|rufnummer|t[eé]l[eé]phone|portable|appelez|tel[eé]fono|m[oó]vil|llame",
    "card": "card|visa|mastercard|amex|credit|debit|cvv|expires|pay|karte|kreditkarte|carte|bancaire|tarjeta|cr[eé]dito",
    "tax": "ssn|social security|tax id|passport|licen[cs]e no|national id|insurance|patient|member id|steuernummer|ausweis|reisepass|versicherung|passeport|s[eé]curit[eé] sociale|pasaporte|dni|nie",
    "bank": "iban|account|acct|bank|swift|bic|routing|transfer|konto|bankverbindung|[uü]berweisung|compte|virement|cuenta|transferencia",
    "mail": "e-?mail|mail|write|contact|reach|schreib(?:en|t)?|[eé]crire|courriel|correo|escriba",
    "born": "born|birth|dob|birthday|geboren|geburtstag|n[eé]e?|naissance|nacid[oa]|nacimiento",
    "host": "ip|host|address|server|addr|client|adresse|serveur|servidor|rechner",
    "thing": "order|invoice|isbn|issn|serial|part|model|version|page|ref|sku|item|total|price|population|figure|table|id no|bestellung|rechnung|seite|artikel|commande|facture|pedido|factura|precio|since|released|published|on|until",
}
#: Titles before these words are brands, characters or works, not persons.
NO_PERSON = "pepper|martens|oetker|who|scholl|scholls|seuss|evil|strange|dre|bean|clean|muscle|robot|potato|monopoly|and|doolittle|fixit|right|wrong|speaker|president|chairman"

FEATURES = (
    *(f"is_{g}" for g in GENERATORS), "length", "digits", "groups", "longest_group", "plus", "parens", "dashes", "dots", "blanks", "colons", "luhn", "first_digit", "distinct_digits", "iban_ok", "marked_at", "no_person", "words",
    *(f"near_{c}" for c in CONTEXT),
)

#: Precision that a generator's threshold must reach on examples held back for it.
PRECISION = 0.97
EXAMPLES = 4000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; empty fails."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return (F.char_length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


#: Elements that a scan goes through at once: arrays grow by copies, so long ones are scanned in pieces.
_PIECE = 128


def scan(xs: Column, merge, zero: Column) -> Column:
    """For each element, the merge of all elements before it.

    Growing one array element by element copies it each time; here only pieces of
    _PIECE and the list of their merges grow, so long arrays cost little more than their length.
    """
    kind = F.array(zero)

    def grown(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.slice(kind, 1, 0).alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def pieced(pieces: Column) -> Column:
        heads = grown(F.transform(pieces, lambda p: F.aggregate(p, zero, merge)), zero)
        return F.flatten(F.zip_with(pieces, heads, lambda p, h: grown(p, h)))

    def of(values: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _PIECE).cast("int")), lambda k: F.slice(values, k * _PIECE + 1, _PIECE))
        return F.when(F.size(values) == 0, F.slice(kind, 1, 0)).otherwise(bound(pieces, pieced))

    return bound(xs, of)


#: Characters of a slice of a text; finding a place in a string takes a walk to it, so long texts are cut once.
_SLICE = 4096


def slices(text: Column) -> Column:
    """The text in slices, each with the one after it."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / _SLICE).cast("int")), lambda k: F.substring(text, k * _SLICE + 1, F.lit(2 * _SLICE)))


def part(text: Column, held: Column, start: Column, length: Column) -> Column:
    """substring(text, start + 1, length) from its slices; only parts longer than one go through the text."""
    near = F.substring(F.get(held, F.floor(start / _SLICE).cast("int")), start % _SLICE + 1, length)
    return F.when(length <= _SLICE, near).otherwise(F.substring(text, start + 1, length))


def places(text: Column, pattern: str, gate: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, s>>, in code points.

    What lies between matches gives the starts, by a running sum of lengths.
    """
    kind = "array<struct<start:int,end:int,s:string>>"
    none = F.array().cast(kind)

    def found(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), F.char_length)

        def placed(gaps: Column) -> Column:
            lengths = F.zip_with(gaps, matches, lambda b, m: b + F.char_length(m))
            before = scan(lengths, lambda a, x: a + x, F.lit(0))
            starts = F.zip_with(before, gaps, lambda at, b: at + b)
            return F.zip_with(starts, matches, lambda at, m: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), m.alias("s"))).cast(kind)

        return F.when(F.size(matches) == 0, none).otherwise(bound(gaps, placed))

    return F.when(F.regexp_like(text, F.lit(gate)), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(none)


def valid(kind: str, s: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.char_length(_digits(s)).between(14, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.char_length(_digits(s)).between(10, 15)
    return F.lit(True)


def iban_ok(s: Column) -> Column:
    """Whether letters as 10 to 35 and digits, the first four last, leave 1 by 97."""
    bare = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55))
    return F.aggregate(codes, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def features(generator: Column, s: Column, before: Column) -> Column:
    """The values of FEATURES as array<double>, from a candidate and the text before it."""
    near = F.lower(before)

    def rest(digits: Column) -> Column:
        groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
        values = [(generator == g) for g in GENERATORS]
        values += [F.char_length(s), F.char_length(digits), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0))]
        values += [F.regexp_count(s, F.lit(p)) for p in (r"\+", r"[()]", "-", r"\.", " ", ":")]
        values += [luhn(digits), F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)), F.size(F.array_distinct(F.split(digits, "")))]
        values += [F.when(generator == "iban", iban_ok(s)).otherwise(False), F.regexp_like(s, F.lit(r"(?i)[(\[]at[)\]]")), F.regexp_like(s, F.lit(rf"(?i)\.? (?:{NO_PERSON})(?![a-z])")), F.regexp_count(s, F.lit(r"\p{L}{2,}"))]
        values += [F.regexp_like(near, F.lit(rf"(?<![a-z])(?:{words})(?![a-z])")) for words in CONTEXT.values()]
        return F.array(*[v.cast("double") for v in values])

    return bound(_digits(s), rest)


def score(x: Column, model: Model) -> Column:
    """The trees as nested conditions over the features."""

    def node(tree: int, i: int) -> Column:
        if i >= 2**model.depth - 1:
            return F.lit(float(model.value[tree, i - (2**model.depth - 1)]))
        if not np.isfinite(model.threshold[tree, i]):
            return node(tree, 2 * i + 1)
        return F.when(F.get(x, F.lit(int(model.feature[tree, i]))) > float(model.threshold[tree, i]), node(tree, 2 * i + 2)).otherwise(node(tree, 2 * i + 1))

    total = F.lit(model.prior)
    for t in range(len(model.value)):
        total = total + node(t, 0)
    return 1 / (1 + F.exp(-total))


#: Cues before made-up candidates, in the four languages.
_CUES = {
    "phone": ("phone", "tel", "call me at", "mobile:", "fax", "contact", "Telefon", "Handy", "téléphone", "teléfono", "llame al"),
    "card": ("card", "visa", "credit card no", "mastercard", "Kreditkarte", "carte", "tarjeta"),
    "tax": ("ssn", "social security", "passport", "tax id", "Steuernummer", "Ausweis", "passeport", "pasaporte"),
    "bank": ("iban", "account", "bank", "transfer to", "Konto", "compte", "cuenta"),
    "mail": ("email", "write to", "mail", "contact", "schreibt", "courriel", "correo"),
    "born": ("born", "date of birth", "dob", "geboren", "née", "nacida"), "host": ("ip", "host", "server", "client", "Rechner", "servidor"),
    "thing": ("order", "invoice", "isbn", "serial", "version", "page", "ref", "item", "total", "price", "model", "Bestellung", "Rechnung", "facture", "pedido", "released", "published", "since", "on"),
}


def examples(n: int = EXAMPLES, seed: int = 7) -> list:
    """Candidates made by rule, with the text before them: (generator, s, before, label).

    Every generator gets personal ones and look-alikes, with and without cues, and some with misleading cues: references and
    amounts for numbers, sentences with at and dot for addresses, codes with a wrong checksum for
    account numbers, clock times and hardware addresses for ipv6, publication dates, brands and titles.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def luhned(k: int) -> str:
        body = rng.choice("3456") + d(k - 2)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def before(cue: str | None) -> str:
        return " ".join([word() for _ in range(rng.randrange(1, 4))] + ([rng.choice(_CUES[cue])] if cue else [])) + rng.choice([" ", ": ", " is ", " no "])

    def iban(good: bool) -> str:
        land, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), d(18)
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in land) + "00") % 97
        whole = f"{land}{check if good else (check + rng.randrange(1, 80)) % 97:02d}{body}"
        return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    out = []
    while len(out) < n:
        kind, good = rng.choice([*GENERATORS, "number", "number", "number"]), rng.random() < 0.5
        # Account numbers and ipv6 may stand after any cue, the others after their own or none.
        own = {"number": "phone", "hidden_email": "mail", "iban": "bank", "ipv6": "host", "date": "born", "name": None}[kind]
        cue = rng.choice([own, own, None]) if good else rng.choice(["thing", "thing", None])
        if kind == "number" and good:
            form = rng.choice(["phone", "card", "tax"])
            if form == "phone":
                s = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 ({}) {}-{}", "+1-{}-{}-{}", "0049 {} {}{}"]).format(d(3), d(3), d(4))
                cue = "phone" if not ("(" in s or "+" in s) else rng.choice(["phone", None])
            elif form == "card":
                k = luhned(16)
                s, cue = rng.choice([k, " ".join(k[i : i + 4] for i in range(0, 16, 4)), "-".join(k[i : i + 4] for i in range(0, 16, 4)), luhned(15)]), rng.choice(["card", None])
            else:
                s, cue = f"{d(3)}-{d(2)}-{d(4)}", rng.choice(["tax", None])
        elif kind == "number":
            s = rng.choice([d(7), d(8), d(9), d(10), d(12), d(13), d(16), f"{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}", f"{d(3)}-{d(3)}-{d(4)}", " ".join([*(d(4) for _ in range(rng.randrange(2, 5))), d(2)])])
        elif kind == "hidden_email":
            s = rng.choice(["{} (at) {} (dot) com", "{}[at]{}[dot]org", "{} at {} dot net"]).format(word(), word()) if good else f"{word()} at {word()} dot {word()}"
            cue = "mail" if good and " at " in s else cue
        elif kind == "iban":
            s = iban(good) if good or rng.random() < 0.7 else f"{rng.choice(['AB', 'XK', 'SN', 'PO'])}{d(2)} {d(4)} {d(4)} {d(4)}"
        elif kind == "ipv6":
            full = ":".join(hexes(4) for _ in range(8))
            s = rng.choice([full, full[:9] + "::" + full[-4:], full[:19] + "::" + full[-4:]]) if good else rng.choice([":".join(d(2) for _ in range(4)), ":".join(hexes(2) for _ in range(6)), ":".join(d(1) for _ in range(5))])
        elif kind == "date":
            s = rng.choice(["{0}.{1}.{2}", "{0}/{1}/{2}", "{2}-{1:02d}-{0:02d}"]).format(rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1930, 2020))
            cue = "born" if good else cue
        else:
            title = rng.choice(["Mr", "Mrs.", "Dr.", "Ms", "Prof."])
            s = f"{title} {word().title()} {word().title()}" if good else f"{title} {rng.choice(NO_PERSON.split('|')).title()}{rng.choice(['', ' ' + word().title()])}"
        if kind in ("iban", "ipv6") and rng.random() < 0.1:
            cue = rng.choice(list(_CUES))
        out.append((kind, s, before(cue), int(good)))
    return out


def fit(spark: SparkSession, rows: list) -> tuple:
    """Trees fitted to three quarters of the examples, and each generator's threshold, calibrated on the rest.

    A threshold is the least score down to which PRECISION of the calibration examples of its generator
    are personal; a generator that never reaches it reports nothing.
    """
    x, y = vectors(spark, rows), np.array([label for *_, label in rows], float)
    back = np.arange(len(y)) % 4 == 0
    model = train(x[~back], y[~back], trees=32, depth=4, rate=0.3, bins=96)
    p = model.score(x[back])
    thresholds = {}
    for k, g in enumerate(GENERATORS):
        mine = x[back][:, k] == 1
        right, best = 0, 2.0
        for n, (value, label) in enumerate(sorted(zip(p[mine], y[back][mine]), key=lambda r: (-r[0], r[1])), 1):
            right += label
            if right / n >= PRECISION:
                best = float(value)
        thresholds[g] = max(0.5, best)
    return model, thresholds


def vectors(spark: SparkSession, rows: list) -> np.ndarray:
    """The features of examples, from the same expressions as those of documents."""
    text = json.dumps([{"i": i, "g": g, "s": s, "b": b} for i, (g, s, b, _) in enumerate(rows)])
    held = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<i:int,g:string,s:string,b:string>>")).alias("r"))
    got = sorted(held.select("r.i", features(F.col("r.g"), F.col("r.s"), F.col("r.b")).alias("x")).collect())
    return np.array([r.x for r in got])


def quality(spark: SparkSession, seed: int) -> dict:
    """Precision and recall by generator on fresh examples of another seed."""
    model, thresholds = fitted(spark)
    rows = examples(seed=seed)
    p, y = model.score(vectors(spark, rows)), np.array([label for *_, label in rows])
    out = {}
    for g in GENERATORS:
        mine = np.array([r[0] == g for r in rows])
        taken = p[mine] >= thresholds[g]
        right = (taken & (y[mine] == 1)).sum()
        out[g] = (float(right / max(1, taken.sum())), float(right / max(1, y[mine].sum())))
    return out


_FITTED: dict = {}


def fitted(spark: SparkSession) -> tuple:
    """The trees and each generator's threshold: fitted to EXAMPLES made-up candidates, once a process."""
    if not _FITTED:
        model, thresholds = fit(spark, examples())
        _FITTED.update(model=model, thresholds=thresholds)
    return _FITTED["model"], _FITTED["thresholds"]


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _validator(kind: str):
    return lambda m: valid(kind, m["s"])


def _named(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["s"].alias("s"))


def _span(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "all_spans")


def apart(base: Column, candidates: Column) -> Column:
    """The candidates that touch no base span; both in order of their starts.

    In the order of both, a base span touches a candidate if the greatest end before it lies
    behind its start, or the least start after it before its end.
    """
    far = F.lit(2147483647)

    def kept(all_: Column) -> Column:
        ends = scan(F.transform(all_, lambda x: F.when(x["rank"] < len(KINDS), x["end"]).otherwise(0)), lambda a, x: F.greatest(a, x), F.lit(0))
        starts = F.reverse(scan(F.reverse(F.transform(all_, lambda x: F.when(x["rank"] < len(KINDS), x["start"]).otherwise(far))), lambda a, x: F.least(a, x), far))
        rows = F.zip_with(F.zip_with(all_, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda r, n: F.struct(r["x"].alias("x"), ((r["x"]["rank"] >= len(KINDS)) & (r["e"] <= r["x"]["start"]) & (n >= r["x"]["end"])).alias("ok")))
        return F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: r["x"])

    whole = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("s")))
    return F.when(F.size(base) == 0, candidates).otherwise(bound(F.array_sort(F.concat(whole, candidates)), kept))


def best(scored: Column) -> Column:
    """Of overlapping spans (start, rank, kind, end, p) the better score, then the earlier; scored: in order of starts.

    Spans are cut into runs where no span before reaches the next one; in a run the best
    is taken, then the best that touches none taken, and so on.
    """
    none = F.array().cast(_SPAN)

    def take(acc: Column, c: Column) -> Column:
        return F.when(F.exists(acc, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), acc).otherwise(F.concat(acc, F.array(_span(c)).cast(_SPAN)))

    def resolved(run: Column) -> Column:
        order = F.array_sort(F.transform(run, lambda c: F.struct((-c["p"]).alias("p"), *[c[k].alias(k) for k in ("start", "rank", "kind", "end")])))
        return F.when(F.size(run) == 1, F.transform(run, _span).cast(_SPAN)).otherwise(F.aggregate(order, none, take))

    def runs(reach: Column) -> Column:
        first = F.filter(F.zip_with(F.sequence(F.lit(1), F.size(scored)), F.zip_with(scored, reach, lambda c, e: c["start"] >= e), lambda i, new: F.when(new, i)), lambda i: i.isNotNull())
        return bound(first, lambda f: F.flatten(F.transform(f, lambda at, k: bound(F.slice(scored, at, F.coalesce(F.get(f, k + 1), F.size(scored) + 1) - at), resolved))))

    return F.when(F.size(scored) > 0, bound(scan(F.transform(scored, lambda c: c["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), runs)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """Adds to each document its base counts and all spans.

    Base spans stay as they are. The generators' candidates that no base span
    touches are scored; those at or above their generator's threshold are spans
    of the generator's kind; of overlapping ones the better score stays, then
    the earlier one. All is done row by row, without a shuffle, in little more than the
    time that reading the text and its spans once takes.

    Adds n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of
    start, rank, kind, end, ordered). Null or empty text: none. Ties and repeated rows:
    rows as they stand. Empty table: empty result. Other columns stay; those with the
    names of added ones are replaced, inner names clash with none.
    """
    plain, back = guarded(docs, ("text",))
    model, thresholds = fitted(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = fixed(plain, {f"{kind}__": F.filter(places(text, BASE[kind], GATES[kind]), _validator(kind)) for kind in KINDS})
    spans = [F.transform(f"{kind}__", _named(i, kind)) for i, kind in enumerate(KINDS)]
    counts = {f"n_{kind}": F.size(f"{kind}__").cast("long") for kind in KINDS}
    d = fixed(d, {"base_spans": F.array_sort(F.transform(F.concat(*spans), _span)), **counts})
    candidate = [F.transform(places(text, pattern, GENERATOR_GATES[g]), _named(len(KINDS) + i, g)) for i, (g, pattern) in enumerate(GENERATORS.items())]
    d = fixed(d, {"candidates__": F.concat(*candidate)})
    d = fixed(d, {"candidates__": F.when(F.size("candidates__") > 0, apart(F.col("base_spans"), F.array_sort("candidates__"))).otherwise(F.col("candidates__"))})
    limit = F.create_map(*[F.lit(v) for g in GENERATORS for v in (g, thresholds[g])])

    def scored(c: Column, held: Column) -> Column:
        before = part(text, held, F.greatest(c["start"] - CONTEXT_CHARS, F.lit(0)), F.least(c["start"], F.lit(CONTEXT_CHARS)))
        p = bound(features(c["kind"], c["s"], before), lambda x: score(x, model))
        return F.struct(*[c[k].alias(k) for k in ("start", "rank", "kind", "end")], p.alias("p"))

    d = fixed(d, {"chosen__": F.when(F.size("candidates__") > 0, bound(slices(text), lambda held: F.transform("candidates__", lambda c: scored(c, held))))})
    d = fixed(d, {"chosen__": F.filter("chosen__", lambda c: c["p"] >= F.element_at(limit, c["kind"]))})
    more = F.when(F.size("chosen__") > 0, best(F.col("chosen__"))).otherwise(F.array().cast(_SPAN))
    d = fixed(d, {"all_spans": F.array_sort(F.concat("base_spans", more))})
    return back(d, ADDED)


def joined(spans: Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the parts that earlier ones left."""

    def cut(ends: Column, held: Column) -> Column:
        """ends: how far the spans before each one reach."""
        parts = F.zip_with(spans, ends, lambda s, e: F.when(s["end"] > e, F.concat(part(text, held, e, F.greatest(s["start"] - e, F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bound(scan(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), lambda ends: bound(slices(text), lambda held: cut(ends, held))))


def op6_pii_spans(spark, sf_dir):
    """Personal data in every whole document."""
    found = find(table(spark, sf_dir, "documents"))
    digest = F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, joined(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))
