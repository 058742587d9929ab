"""Secret scan: a keyword automaton finds places, anchored patterns match there, checksums decide.

One Aho-Corasick pass over the lower-cased bytes of a text yields the keyword hits; a
pattern is only tried where a hit starts, never over the whole text. Kinds without a
keyword (bare hexadecimal runs) are found in a class image of the text, in which every
hexadecimal digit is the same byte, by looking for the shortest accepted run. Vendor
tokens that embed a checksum (and web tokens that embed a header) are only reported if
it holds.

Rows: one result per document. A null or empty text has no spans; texts of any length are
scanned whole; repeated rows give repeated results; other columns are kept, except that
``spans`` and ``found`` are replaced. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared

# The kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
# Keyword (lower case) -> kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
}
# What must start at a keyword hit.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT_HEAD = re.compile(rb"eyJ[A-Za-z0-9_-]+")
JWT_REST = re.compile(rb"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_IMAGE = bytes(0x68 if c in b"0123456789abcdef" else 0x20 for c in range(256))

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def base62_crc(body: bytes) -> str:
    """CRC-32 of ``body`` as six base-62 digits, the checksum that prefixed vendor tokens end in."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _checksummed(pattern: re.Pattern) -> Callable[[bytes, int], tuple[int, bool] | None]:
    def at(raw: bytes, p: int):
        m = pattern.match(raw, p)
        return m and (m.end(), base62_crc(m[1]).encode() == m[2])

    return at


def _jwt(raw: bytes, p: int):
    start = JWT_HEAD.match(raw, p)
    if not start:
        return None
    m = JWT_REST.match(raw, start.end())
    if not m:
        # Whatever else starts within this run ends with it and fails alike.
        return start.end(), False
    head = start[0]
    try:
        ok = "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        ok = False
    return m.end(), ok


def _assign(raw: bytes, p: int):
    m = ASSIGN.match(raw, p)
    return m and (m.end(), len(m[1]) >= MIN_ASSIGN)


def _access(raw: bytes, p: int):
    m = ACCESS.match(raw, p)
    return m and (m.end(), m.end() - p >= MIN_ACCESS)


#: kind -> what stands at a byte position: None, or the match's end and whether it counts.
ANCHORED = {"assign": _assign, "access": _access, "github": _checksummed(GITHUB), "npm": _checksummed(NPM), "jwt": _jwt}


def make_scanner() -> Callable[[str | None], list[tuple[str, int, int]]]:
    """A function that lists the ``(kind, start, end)`` spans of a text by start, then kind."""
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    rank = {k: i for i, k in enumerate(KINDS)}
    run = b"\x68" * MIN_HEX

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        found = []
        # A match that fails its length or checksum still uses up its text, as in a left-to-right search.
        used = dict.fromkeys(ANCHORED, 0)
        for start, kind in sorted((end - n + 1, kind) for end, (n, kind) in automaton.iter(raw.lower().decode("latin-1"))):
            if start >= used[kind] and (hit := ANCHORED[kind](raw, start)):
                used[kind] = hit[0]
                if hit[1]:
                    found.append((start, rank[kind], hit[0]))
        image = raw.translate(HEX_IMAGE)
        p = image.find(run)
        while p >= 0:
            end = image.find(b"\x20", p)
            end = len(raw) if end < 0 else end
            found.append((p, rank["hex"], end))
            p = image.find(run, end)
        found.sort()
        if len(raw) == len(text):
            return [(KINDS[k], s, e) for s, k, e in found]
        # From bytes to code points; starts ascend, so each stretch of text is counted once.
        out, at, chars = [], 0, 0
        for s, k, e in found:
            chars += len(raw[at:s].decode("utf-8", "surrogatepass"))
            at = s
            out.append((KINDS[k], chars, chars + e - s))  # matches are ASCII
        return out

    return scan


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with an array of ``(kind, start, end)`` in ``spans``."""
    prepared(docs.sparkSession)

    def make():
        scan = make_scanner()
        return lambda t: ([{"kind": k, "start": s, "end": e} for k, s, e in scan(t)],)

    return add_columns(docs, [text], [T.StructField(spans, T.ArrayType(SPAN))], make)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; overlapping spans become one."""
    prepared(docs.sparkSession)

    def make():
        scan = make_scanner()

        def row(t):
            spans = scan(t)
            if not spans:
                return (t,)
            out, at = [], 0
            for kind, s, e in spans:
                if s >= at:
                    out += [t[at:s], mark.format(kind)]
                at = max(at, e)
            return ("".join([*out, t[at:]]),)

        return row

    order = docs.columns
    return add_columns(docs, [text], [T.StructField(text, T.StringType())], make).select(*[f"`{c}`" for c in order])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest row per document: counts of the base kinds, hash of their spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
