"""Token counts by section: a document is encoded once, its tokens' spans meet the sections' spans.

The tokenizer's ranks are byte strings whose concatenation is the text, so the token
ends are running sums of byte lengths; these are mapped to code points and joined to the
sections' character spans as sorted intervals. A token that crosses a boundary is
allocated by an explicit rule:

* ``start``: to the section of its first character (counts stay whole and sum to the
  document's tokens);
* ``end``: to the section of its last character;
* ``share``: to every section it touches, by the part of its bytes that lies there.

Sections partition the text: line by line (a line feed belongs to the line it ends), or
the spans of an array column. Text outside all spans is section -1. Null and empty texts
have no tokens and no sections; whole texts are encoded; further columns are kept.
"""

from __future__ import annotations

import base64
import functools
import os
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RULES = ("start", "end", "share")

SECTION = T.StructType([
    T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType()),
])


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """``(encode, byte length of each token)``; kept per worker process, as loading takes longer than a batch."""
    import tiktoken

    folder = os.path.dirname(os.path.realpath(path))
    sys.path.insert(0, os.path.dirname(folder))
    try:
        import public_tokenizers as tables
    finally:
        sys.path.pop(0)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    enc = tiktoken.Encoding("ranks", pat_str=tables.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary, lengths


def line_bounds(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out if out[-1][0] < out[-1][1] else out[:-1]


def attribute(text: str, bounds: list[tuple[int, int]], ids: np.ndarray, lengths: np.ndarray, rule: str) -> list[dict]:
    """Tokens per section; ``bounds`` are disjoint, ascending code-point spans."""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    # Byte offset of every code point; the spans go to bytes once, where the tokens live.
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    lo = at[np.minimum([b[0] for b in bounds], len(at) - 1)] if bounds else np.zeros(0, np.int64)
    hi = at[np.minimum([b[1] for b in bounds], len(at) - 1)] if bounds else np.zeros(0, np.int64)

    def section_of(p: np.ndarray) -> np.ndarray:
        """Index of the section that holds byte ``p``, or -1."""
        i = np.searchsorted(lo, p, "right") - 1
        return np.where((i >= 0) & (p < hi[np.maximum(i, 0)]), i, -1) if len(lo) else np.full(len(p), -1)

    first, last = section_of(starts), section_of(ends - 1)
    crossing = first != last
    n = len(bounds)
    if rule == "share":
        counts = np.zeros(n + 1)
        np.add.at(counts, first[~crossing], 1.0)
        for i in np.flatnonzero(crossing):
            own = section_of(np.arange(starts[i], ends[i]))
            np.add.at(counts, own, 1.0 / sizes[i])
    else:
        counts = np.bincount(np.where((own := first if rule == "start" else last) < 0, n, own), minlength=n + 1).astype(float)
    touch = np.zeros(n + 1, np.int64)
    np.add.at(touch, first[crossing], 1)
    np.add.at(touch, last[crossing], 1)
    out = [{"section": i, "start": s, "end": e, "n_tokens": float(counts[i]), "n_crossing": int(touch[i])} for i, (s, e) in enumerate(bounds)]
    if counts[n] or touch[n]:
        out.append({"section": -1, "start": None, "end": None, "n_tokens": float(counts[n]), "n_crossing": int(touch[n])})
    return out


def attribute_tokens(docs: DataFrame, text: str = "text", spans: str | None = None, rule: str = "start", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``docs`` with ``n_tokens`` and an array ``sections`` of counts per section.

    ``spans``: a column of ``array<struct<start,end>>`` (disjoint, ascending); lines if not given.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepared(docs.sparkSession)

    def make() -> Callable[..., tuple]:
        encode, lengths = encoder(ranks)

        def row(t, given=None):
            if not t:
                return 0, []
            ids = np.asarray(encode(t), np.int64)
            bounds = line_bounds(t) if spans is None else [(s["start"], s["end"]) for s in given or ()]
            return len(ids), attribute(t, bounds, ids, lengths, rule)

        return row

    inputs = [text] if spans is None else [text, spans]
    return add_columns(docs, inputs, [T.StructField("n_tokens", T.LongType()), T.StructField("sections", T.ArrayType(SECTION))], make)


def section_counts(docs: DataFrame, rule: str = "start", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """One row per document and line: its span, tokens, tokens that cross its boundary, and the document's tokens."""
    counted = attribute_tokens(docs.select("doc_id", "text"), rule=rule, ranks=ranks).select("doc_id", F.col("n_tokens").alias("doc_tokens"), "sections")
    return counted.select("doc_id", "doc_tokens", F.inline_outer("sections"))
