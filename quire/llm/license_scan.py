"""License scan: a positional index of licence words, intersected by relative position, rarest words first.

Every phrase and notice below is a template, a list of words, and all its words are
postings ``word -> (template, offset)``. The corpus is read once to count in how many
documents each licence word stands (one row per word and task is shuffled; the table is
bounded by the templates' vocabulary, never by the corpus), which gives their IDF.

In a file, a notice is a candidate if all words of its mandatory phrase and half its words
occur at all. The file's own words of that notice are looked up by falling IDF, a few at a
time. A word's positions less its offsets are places where the notice may begin;
they are intersected: a place stands if two different words agree on it, within the slack.
There the mandatory phrase is verified word for word, and half of the notice's words must
stand in place. The next words are looked up only while no place is verified, so frequent words
are seldom touched and no notice is missed. Its score is the IDF-weighted share of its words at the best place found.

Base phrases are found completely: their rarest word is a posting, and each of its
positions is verified word for word.

Rows: one result per document. Null and empty texts have no words; whole texts are read;
equal documents give equal rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening words of public licence notices; label -> (notice, mandatory phrase).
NOTICES = {
    "afl": ("licensed under the academic free license version 3 0", "academic free license"),
    "agpl": ("gnu affero general public license", "affero general public license"),
    "apache": ("licensed under the apache license version 2 0", "apache license"),
    "apache-header": ("you may not use this file except in compliance with the license", "except in compliance with the license"),
    "artistic": ("licensed under the artistic license 2 0", "artistic license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "bsd-short": ("released under the bsd license", "bsd license"),
    "bsl": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization obtaining a copy"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "cc by nd"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("cc0 1 0 universal", "cc0"),
    "creative-commons": ("licensed under a creative commons attribution license", "creative commons attribution"),
    "epl": ("made available under the terms of the eclipse public license", "eclipse public license"),
    "gnu-gpl": ("this work is licensed under the gnu general public license version 3", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "to any person obtaining a copy of this software"),
    "mit-short": ("released under the mit license", "mit license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "proprietary": ("unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    "zlib": ("this software is provided as is without any express or implied warranty", "provided as is without any express or implied warranty"),
}
#: So many of a file's rarest words are looked up at a time, and so large a part of a notice's words must stand in place.
RARE_WORDS, MIN_SHARE = 4, 0.5
#: So many different words must agree on a place.
VOTES = 2
#: A word may stand this many places off its own because of words put in or left out.
SLACK = 2

# Everything in ASCII but letters and digits separates words; bytes from 0x80 on belong to words.
SEPARATORS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).split() if text else []


def vocabulary() -> list[bytes]:
    phrases = [*BASE, *(n for n, _ in NOTICES.values())]
    return sorted({w.encode() for p in phrases for w in p.split()})


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n_docs)`` of the licence words over all documents, and ``('', number of documents)``."""
    known = frozenset(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for t in b.column(0):
                n[b""] += 1
                for w in known.intersection(words_of(t.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in n], "n_docs": list(n.values())})

    prepared(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "word string, n_docs long").groupBy("word").agg(F.sum("n_docs").alias("n_docs"))


def idf_of(counts: dict[bytes, int]) -> dict[bytes, float]:
    """IDF of the licence words, above zero for a word of every document; ``b""`` counts the documents."""
    return {w: math.log1p((1 + counts.get(b"", 0)) / (1 + counts.get(w, 0))) for w in vocabulary()}


def agreed(starts: list[tuple[int, bytes]]) -> list[int]:
    """Of possible starts, by looked-up word, those that ``VOTES`` different words agree on within twice the slack."""
    starts = sorted(starts)
    out: list[int] = []
    inside: dict[bytes, int] = defaultdict(int)
    lo = hi = 0
    for s, _ in starts:
        while hi < len(starts) and starts[hi][0] <= s + 2 * SLACK:
            inside[starts[hi][1]] += 1
            hi += 1
        while starts[lo][0] < s - 2 * SLACK:
            inside[starts[lo][1]] -= 1
            if not inside[starts[lo][1]]:
                del inside[starts[lo][1]]
            lo += 1
        if len(inside) >= VOTES and (not out or out[-1] != s):
            out.append(s)
    return out


def make_matcher(idf: dict[bytes, float]) -> Callable[[list[bytes]], tuple[list[tuple[int, str]], dict[str, float]]]:
    """A function from words to the base places ``(start, label)`` and the score of each notice found."""
    rank = lambda w: (-idf.get(w, 0.0), w)
    base: dict[bytes, list[tuple[int, list[bytes], str]]] = defaultdict(list)
    for phrase, label in BASE.items():
        ws = phrase.encode().split()
        i = min(range(len(ws)), key=lambda i: rank(ws[i]))
        base[ws[i]].append((i, ws, label))
    postings: dict[bytes, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    notices = {}
    for label, (notice, key) in NOTICES.items():
        ws, ks = notice.encode().split(), key.encode().split()
        at = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        notices[label] = (ws, ks, at, frozenset(ks))
        for i, w in enumerate(ws):
            postings[w][label].append(i)
    known = frozenset([*base, *postings])

    def verified(label: str, words: list[bytes], start: int) -> float:
        """Best score of the notice with its mandatory phrase within the slack of ``start``; 0 if there is none."""
        ws, ks, k, _ = notices[label]
        best = 0.0
        for o in range(start - SLACK, start + SLACK + 1):
            if o + k >= 0 and words[o + k : o + k + len(ks)] == ks:
                met = [w for i, w in enumerate(ws) if w in words[max(0, o + i - SLACK) : max(0, o + i + SLACK + 1)]]
                if len(met) >= MIN_SHARE * len(ws):
                    best = max(best, sum(idf[w] for w in met) / sum(idf[w] for w in ws))
        return best

    def match(words: list[bytes]):
        present = known.intersection(words)
        candidates = [n for n, (ws, _, _, key) in notices.items() if key <= present and sum(w in present for w in ws) >= MIN_SHARE * len(ws)]
        wanted = {w for w in present if w in base or any(n in postings[w] for n in candidates)}
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words) if wanted else ():
            if w in wanted:
                at[w].append(p)
        places = [(p - i, label) for w in wanted for i, ws, label in base.get(w, ()) for p in at[w] if p >= i and words[p - i : p - i + len(ws)] == ws]

        scores: dict[str, float] = {}
        ranked = sorted(wanted, key=rank)
        for n in candidates:
            own = [w for w in ranked if n in postings[w]]
            starts: list[tuple[int, bytes]] = []
            tried: set[int] = set()
            for d in range(0, len(own), RARE_WORDS):
                starts += [(p - i, w) for w in own[d : d + RARE_WORDS] for i in postings[w][n] for p in at[w]]
                fresh = [s for s in agreed(starts) if s not in tried]
                tried.update(fresh)
                best = max((verified(n, words, s) for s in fresh), default=0.0)
                if best:
                    scores[n] = best
                    break
        return sorted(places), scores

    return match


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its number of words, base places, labels and the best score of a notice (1 for a base phrase)."""
    counts = {r["word"].encode(): r["n_docs"] for r in document_frequencies(docs, text).collect()}  # at most the vocabulary
    idf = idf_of(counts)

    def make():
        match = make_matcher(idf)

        def row(t):
            words = words_of(t)
            places, shares = match(words)
            base = {label for _, label in places}
            return (
                len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                ",".join(sorted(base)), ",".join(sorted(base | set(shares))), 1.0 if base else max(shares.values(), default=0.0),
            )

        return row

    return add_columns(docs, [text], FIELDS, make)
