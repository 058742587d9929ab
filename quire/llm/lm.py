"""Language-model scores from a weighted backoff automaton over the whole training corpus.

States are contexts of up to ``ORDER - 1`` words, the root is the empty one. A state has an
arc for every word seen after it, with the smoothed probability as weight, and a failure
arc to the state of the next shorter context, with the backoff weight. Smoothing is
Dirichlet: with strength k,

    p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k),

so the arc's weight is p(w | h), the failure arc's k / (c(h) + k), and the probabilities of
a state sum to one. At the root a word has the base probability (c + 0.5) / (N + 0.5 (V + 1)),
one share being the unseen words'.

The automaton holds every n-gram of the corpus, uncut, and is far larger than a task's
memory, so a batch of documents gets the part that it can walk:

1. Documents are dealt into batches of bounded text by hash of their id. A batch makes its
   distinct n-grams with their counts in its training documents, packed by shard.
2. A shard adds up its n-grams over all batches and answers each batch in its own order.
   There are as many shards as keep one within memory.
3. A batch meets its answers again, builds its part of the automaton, and walks its texts
   from left to right, adding up the weights of the arcs taken. (The state after a word
   follows from the last words, so the arcs of all steps are looked up in one go.)

What is shuffled grows with the text, and nothing but two totals reaches the driver.
N-grams are known by 64-bit hashes, orders above one by their 40 lower bits within a shard.

Rows: one per document. A null or empty text is one end token; whole texts are scored;
a null id counts as a training id; repeated rows count repeatedly; other columns are not
read. An empty table gives an empty result; without training text all words are unseen.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import prepared
from quire.llm.minhash import WordHashes, mix, words_of
from quire.session import stage_table

ORDER = 2
STRENGTH = 300.0
#: Characters of text in a batch, and n-grams that meet in a shard, about.
BATCH_CHARS, SHARD_GRAMS = 6_000_000, 2_000_000
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0x51ED270B9A4F3D17)  # the token after the last word
LOW_BITS = np.uint64((1 << 40) - 1)


class BatchGrams:
    """The n-grams of a batch: per order the distinct keys and, per position, the index of its key (or -1)."""

    def __init__(self, texts: list, order: int):
        hashes = WordHashes()
        parts = []
        for t in texts:
            words = words_of(t)
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            h[-1] = END
            parts.append(h)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), self.lengths)
        before = np.arange(len(tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        key = mix(tokens)
        for n in range(1, order + 1):
            if n > 1:  # the n-gram that ends here: the shorter one that ends a token earlier, and this token
                key = mix(np.concatenate([key[:1], key[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + tokens)
            at = np.flatnonzero(before >= n - 1)
            distinct, inverse = np.unique(key[at], return_inverse=True)
            index = np.full(len(tokens), -1, np.int64)
            index[at] = inverse
            self.keys.append(distinct)
            self.index.append(index)

    def by_shard(self, n: int, shards: int):
        """``(shard, positions in keys[n])`` of the order-(n+1) keys."""
        shard = (self.keys[n] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for p in range(shards):
            if edges[p] < edges[p + 1]:
                yield p, order[edges[p] : edges[p + 1]]


def pack_keys(keys: np.ndarray, n: int, shards: int) -> bytes:
    if n == 0:
        return keys.tobytes()
    low = ((keys // np.uint64(shards)) & LOW_BITS).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # the upper bytes are nearly all zero


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _asks(group: pa.Table, order: int, shards: int) -> pa.Table:
    """A batch's distinct n-grams and their counts in its training documents, one row per order and shard."""
    grams = BatchGrams(group.column("text").to_pylist(), order)
    trained = ~np.asarray(group.column("held_out"))[grams.doc]
    batch = group.column("batch")[0].as_py()
    rows: dict[str, list] = {"shard": [], "batch": [], "n": [], "keys": [], "counts": []}
    for n in range(order):
        own = grams.index[n][trained]
        counts = np.bincount(own[own >= 0], minlength=len(grams.keys[n]))
        for shard, at in grams.by_shard(n, shards):
            for name, v in zip(rows, (shard, batch, n, pack_keys(grams.keys[n][at], n, shards), pack_counts(counts[at])), strict=True):
                rows[name].append(v)
    return pa.table(rows, schema=ASKS)


ASKS = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def _answers(group: pa.Table) -> pa.Table:
    """Counts over all batches, in the order of each ask; and the shard's distinct and total tokens."""
    rows: dict[str, list] = {f.name: [] for f in ANSWERS}
    shard = group.column("shard")[0].as_py()
    orders = np.asarray(group.column("n"))

    def add(*values):
        for name, v in zip(rows, values, strict=True):
            rows[name].append(v)

    for n in np.unique(orders):
        at = np.flatnonzero(orders == n)
        keys = [unpack_keys(group.column("keys")[int(i)].as_py(), n) for i in at]
        counts = np.concatenate([unpack_counts(group.column("counts")[int(i)].as_py()) for i in at])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, inverse, counts)
        whole = sums[inverse]
        edges = np.cumsum([0] + [len(k) for k in keys])
        for k, i in enumerate(at):
            add(group.column("batch")[int(i)].as_py(), shard, int(n), pack_counts(whole[edges[k] : edges[k + 1]]), None, None)
        if n == 0:
            add(-1, shard, 0, None, int((sums > 0).sum()), int(sums.sum()))
    return pa.table(rows, schema=ANSWERS)


SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])


class Automaton:
    """The part of the backoff automaton that a batch's texts can walk."""

    def __init__(self, counts: list[np.ndarray], total: int, distinct: int, strength: float):
        self.counts, self.strength = counts, strength
        self.root = (counts[0] + 0.5) / (total + 0.5 * (distinct + 1))

    def walk(self, grams: BatchGrams) -> np.ndarray:
        """log10 probability of every token, walking each text from its start."""
        p = self.root[grams.index[0]]
        for n in range(1, len(self.counts)):
            at = np.flatnonzero(grams.index[n] >= 0)
            context = self.counts[n - 1][grams.index[n - 1][at - 1]]  # the state reached by the words before
            seen = self.counts[n][grams.index[n][at]]  # 0: no arc, the failure arc is taken
            p[at] = (seen + self.strength * p[at]) / (context + self.strength)
        return np.log10(p)


def _scores(docs: pa.Table, answers: pa.Table, order: int, shards: int, total: int, distinct: int, strength: float) -> pa.Table:
    if not docs.num_rows:
        return SCORES.empty_table()
    grams = BatchGrams(docs.column("text").to_pylist(), order)
    got = {(n, s): i for i, (n, s) in enumerate(zip(answers.column("n").to_pylist(), answers.column("shard").to_pylist(), strict=True))}
    counts = []
    for n in range(order):
        c = np.zeros(len(grams.keys[n]), np.int64)
        for shard, at in grams.by_shard(n, shards):
            c[at] = unpack_counts(answers.column("counts")[got[n, shard]].as_py())
        counts.append(c)
    automaton = Automaton(counts, total, distinct, strength)
    n_docs = docs.num_rows
    add = lambda v: np.bincount(grams.doc, v, n_docs)
    words = counts[0][grams.index[0]]
    return pa.table({
        "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": grams.lengths,
        "n_known": add((words > 0).astype(float)).astype(np.int64), "train_tokens": np.full(n_docs, total),
        "base_score": add(np.log10(automaton.root[grams.index[0]])), "score": add(automaton.walk(grams)),
    }, schema=SCORES)


def score_documents(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Scores of every document of ``docs`` (doc_id, text); those of fold ``HELD_OUT`` are not learned from."""
    prepared(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, -(-chars // BATCH_CHARS))
    # A word has five letters or so, and most words start an n-gram that is new to their batch.
    shards = max(1, -(-chars * order // (6 * SHARD_GRAMS)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    dealt = docs.select("doc_id", "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    asks = dealt.groupBy("batch").applyInArrow(
        lambda g: _asks(g, order, shards), "shard long, batch long, n int, keys binary, counts binary"
    )
    answers = stage_table(
        asks.groupBy("shard").applyInArrow(_answers, "batch long, shard long, n int, counts binary, distinct long, total long"), "answers"
    )
    distinct, total = answers.where("batch = -1").agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = distinct or 0, total or 0
    own = answers.where("batch >= 0").select(F.col("batch").alias("to"), "shard", "n", "counts")
    return dealt.groupBy("batch").cogroup(own.groupBy("to")).applyInArrow(
        lambda d, a: _scores(d, a, order, shards, total, distinct, strength),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
