"""Secret scans: named patterns, and novelty against a primed zstandard dictionary."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from .common import table

KINDS = ("assign", "access", "hex")

#: The three base patterns.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: No assignment without one of these in the lower-cased text.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Words after which a string is in a sensitive context.
CONTEXT_WORDS = (
    "access", "account", "api", "apikey", "auth", "authorization", "bearer", "client", "connection", "credential",
    "credentials", "dsn", "encryption", "jwt", "key", "login", "oauth", "passphrase", "passwd", "password", "private",
    "pwd", "salt", "secret", "secrets", "session", "sig", "signature", "signing", "ssh", "token", "webhook",
)
_CONTEXT = re.compile(r"(?ai:(?<![a-z0-9])(?:" + "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True)) + r")(?![a-z]))")
#: Characters of context before a candidate.
CONTEXT_CHARS = 48
#: Borders between the parts of a camelCase name.
_PARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Strings that could be secrets: one long run without spaces.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")

#: Identifiers and code that the dictionary is primed with.
PRIME = (
    "import from return class def function const let var public private static void string number boolean true false null none "
    "self this new async await try except catch finally raise throw if else elif for while in not and or "
    "config settings environment env getenv process.env os.environ username password passwd secret token api_key apikey access_key "
    "secret_key client_id client_secret private_key public_key auth authorization bearer credentials connection_string database "
    "host port user localhost 127.0.0.1 http https www com org net io example test placeholder changeme your_key_here xxxxxxxx "
    "BEGIN RSA PRIVATE KEY END CERTIFICATE ssh-rsa AAAAB3NzaC1yc2E sha256 sha1 md5 base64 utf-8 json yaml xml html css javascript "
    "python java golang github gitlab docker kubernetes aws azure google cloud storage bucket region us-east-1 eu-west-1 "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ getElementById addEventListener toString valueOf prototype "
)
#: A string is reported when it costs at least so many bytes for each of its characters ...
NOVELTY = 0.55
#: ... and so many bits a character by its own letters.
ENTROPY = 3.0


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, prime: str = PRIME, level: int = 3):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(prime.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def __call__(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, for each of its characters."""
        around = before + " " + after
        return (self.size(around + " " + candidate) - self.size(around)) / max(1, len(candidate))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def base_spans(text: str) -> list:
    """(start, kind index, end) of the three base kinds, in code points."""
    out = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def sensitive(context: str) -> bool:
    """Whether a context word stands there, as a word or as a part of a camelCase or underscore name."""
    return bool(_CONTEXT.search(context) or _CONTEXT.search(_PARTS.sub(" ", context)))


def novel_spans(text: str, novelty: Novelty) -> list:
    """(start, end, score) of incompressible strings in a sensitive context."""
    out = []
    for m in _CANDIDATE.finditer(text):
        word = m[0]
        before = text[max(0, m.start() - CONTEXT_CHARS) : m.start()]
        if not sensitive(before + word.partition("=")[0] if "=" in word else before):
            continue
        score = novelty(before, word, text[m.end() : m.end() + CONTEXT_CHARS])
        if score >= NOVELTY and entropy(word) >= ENTROPY:
            out.append((m.start(), m.end(), score))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, top_novelty double"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: base counts, their digest, and all spans.

    Candidates are all long strings of key characters in a sensitive context; each is reported if the bytes it adds to the compressed
    surroundings, after a dictionary of code and identifiers, are near its
    length. Spans of the method are of kind novel; base spans stay.

    Null or empty text: no spans. Null or repeated doc_id: rows as they stand.
    Empty table: empty result. Other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        novelty = Novelty()
        for batch in batches:
            out: list = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                novel = novel_spans(text, novelty)
                named = [(s, k, KINDS[k], e) for s, k, e in base]
                everything = sorted([*named, *((s, len(KINDS), "novel", e) for s, e, _ in novel)])
                digest = hashlib.sha256(joined([(s, n, e) for s, _, n, e in named]).encode()).hexdigest()
                row = [doc.as_py(), *(sum(k == i for _, k, _ in base) for i in range(3)), digest, joined([(s, n, e) for s, _, n, e in everything]), len(novel), max((x for _, _, x in novel), default=None)]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_secret_scan(spark, sf_dir):
    """Secrets in every whole document."""
    return scan(table(spark, sf_dir, "documents"))
