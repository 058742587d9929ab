"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut by the tokenizer's pattern, and every match is merged by itself. Over the
match's bytes stands a segment tree: a leaf holds the rank of the pair that starts at its
byte (none, if the byte starts no token any more or the pair is no token), an inner node
the least of its two children, ties to the left. The root thus names the next merge. A
merge changes three leaves, those of the merged pair, of its right half and of its left
neighbour, and each change climbs the levels of the tree; neighbours are found by links
over the bytes that still start a token. A match that is itself a token is that token.

Short matches are worked through together: the distinct ones of many texts stand in
matrices, a tree per row, and every round merges once in each row that still has a pair.
Longer ones have a tree each. What has been encoded is remembered up to a bound of
entries and bytes, so memory does not grow with the vocabulary of the corpus.

Rows: null and empty texts have no tokens; whole texts are encoded, in windows, so that
the matches of a long text never stand in memory together; ties of rank go to the left;
repeated rows give repeated results; other columns are kept, one with the output's name
is replaced. Strings that name special tokens are ordinary text. Null ids decode to an
empty byte string; an id that is no token fails. Which characters are letters, digits and
spaces is asked of the tokenizer's library, as versions of Unicode differ.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import prepared

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Longest match, in bytes, that is merged in a matrix; a power of two.
SHORT = 64
#: Cells of a matrix of trees.
CELLS = 1 << 20
#: Code points of a text that are cut into matches at once.
WINDOW = 1 << 20
#: What a pattern's match may depend on beyond its end, in code points: a contraction's letters, a word's first one.
REACH = 4
#: Tokens that are decoded at once.
DECODED = 1 << 18
#: Bounds of what a worker remembers.
MAX_PIECES, MAX_PIECE_BYTES = 400_000, 1 << 25
NONE = np.iinfo(np.int64).max


def rank_file(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes and the pattern that goes with it; read by the driver, a vocabulary has a fixed size."""
    import public_tokenizers as tables

    with open(path or tables.path(RANKS), "rb") as f:
        return f.read(), tables.PATTERN


def stand_ins() -> dict[int, str]:
    """Code points that this machine's ``regex`` takes for another kind of character than the tokenizer's library does.

    The two follow different versions of Unicode. Each such code point has a stand-in of the kind that counts.
    """
    import regex
    import tiktoken

    whole = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = {"\\p{L}": "\u00e9", "\\p{N}": "0", "\\s": "\u2003"}
    theirs, moved = {}, set()
    for kind in kinds:
        engine = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs[kind] = set(bytes(engine.encode_ordinary(whole)).decode())
        moved |= theirs[kind] ^ set(regex.findall(kind, whole))
    return {ord(c): next((kinds[k] for k in kinds if c in theirs[k]), "\x00") for c in moved}


class Vocabulary:
    """Tokens by rank, and the rank of every pair of tokens that together are one."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.lengths, 0))])[:-1]
        self.bytes = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * size + right] = rank
        codes = np.array(sorted(self.pairs), np.int64)
        self.codes, self.merged = codes, np.array([self.pairs[c] for c in codes.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], NONE)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a run of token ids, and the place where each token starts, with the end of all."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or self.lengths[ids].min() < 0):
            raise ValueError("an id that is no token")
        places = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        out = np.empty(places[-1], np.uint8)
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            lo, hi = places[at], places[min(at + DECODED, len(ids))]
            # Where each byte stands in the table: its token's start and the offset within the token.
            shift = np.repeat(self.starts[part] - places[at : at + len(part)], self.lengths[part])
            out[lo:hi] = self.bytes[shift + np.arange(lo, hi)]
        return out, places


def merge_rows(pieces: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Token ids of every piece; a segment tree per row, one merge per row and round."""
    width = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    column = np.arange(width)
    inside = column < lengths[:, None]
    raw = np.zeros((n, width), np.uint8)
    raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.where(inside, vocabulary.of_byte[raw], -1)
    # Links between the bytes that start a token; column ``width`` is the end.
    after = np.broadcast_to(column + 1, (n, width)).copy()
    before = np.broadcast_to(column - 1, (n, width)).copy()

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank == NONE, NONE, rank * width + at)

    ranks = np.where(inside[:, 1:], vocabulary.pair_ranks(ids[:, :-1], np.maximum(ids[:, 1:], 0)), NONE)
    level = np.full((n, width), NONE)
    level[:, :-1] = leaf(ranks, column[:-1])
    tree = [level]
    while level.shape[1] > 1:
        level = np.minimum(level[:, ::2], level[:, 1::2])
        tree.append(level)

    def update(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        tree[0][rows, at] = keys
        for below, above in zip(tree, tree[1:], strict=False):
            at = at >> 1
            above[rows, at] = np.minimum(below[rows, 2 * at], below[rows, 2 * at + 1])

    live = np.flatnonzero(tree[-1][:, 0] != NONE)
    while len(live):
        root = tree[-1][live, 0]
        i = root % width
        j = after[live, i]
        k = after[live, j]
        ids[live, i], ids[live, j] = root // width, -1
        after[live, i] = k
        update(live, j, np.full(len(live), NONE))
        right = k < lengths[live]
        before[live[right], k[right]] = i[right]
        keys = np.full(len(live), NONE)
        keys[right] = leaf(vocabulary.pair_ranks(ids[live[right], i[right]], ids[live[right], k[right]]), i[right])
        update(live, i, keys)
        h = before[live, i]
        left = h >= 0
        rows, h, i = live[left], h[left], i[left]
        update(rows, h, leaf(vocabulary.pair_ranks(ids[rows, h], ids[rows, i]), h))
        live = live[tree[-1][live, 0] != NONE]
    kept = ids >= 0
    return np.split(ids[kept], np.cumsum(kept.sum(axis=1))[:-1])


def merge_long(piece: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Token ids of one piece of any length; the tree is one list, the children of node p are 2p and 2p + 1."""
    n, pairs, size = len(piece), vocabulary.pairs, vocabulary.size
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    ids = vocabulary.of_byte[np.frombuffer(piece, np.uint8)]
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    leaves = np.full(width, NONE)
    leaves[: n - 1] = np.where(ranks == NONE, NONE, ranks * width + np.arange(n - 1))
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    none = int(NONE)
    tree = np.concatenate([[none], *levels[::-1]]).tolist()
    tokens = [*ids.tolist(), -1]
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def update(at: int, key: int) -> None:
        p = width + at
        tree[p] = key
        while p > 1:
            p >>= 1
            left, right = tree[2 * p], tree[2 * p + 1]
            least = left if left < right else right
            if tree[p] == least:
                return
            tree[p] = least

    def key(left: int, right: int, at: int) -> int:
        rank = pairs.get(tokens[left] * size + tokens[right])
        return none if rank is None else rank * width + at

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        tokens[i], tokens[j] = rank, -1
        after[i] = k
        update(j, none)
        if k < n:
            before[k] = i
            update(i, key(i, k, i))
        else:
            update(i, none)
        h = before[i]
        if h >= 0:
            update(h, key(h, i, h))
    out = np.array(tokens[:-1], np.int64)
    return out[out >= 0]


class Encoder:
    """Encodes texts; remembers matches within bounds."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.moved = stand_ins()
        # A first look: one of those of the basic plane, or any beyond it.
        self.odd = re.compile(f"[{re.escape(''.join(chr(c) for c in sorted(self.moved) if c < 0x10000))}\U00010000-\U0010ffff]")
        self.known: dict[str, np.ndarray] = {}
        self.bytes = 0

    def windows(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches over the text, in lists; each list spans about a window."""
        if text.isascii() or not self.odd.search(text) or self.moved.keys().isdisjoint(map(ord, set(text))):
            yield from self._cut(text)
            return
        at = 0
        for found in self._cut(text.translate(self.moved)):
            ends = list(itertools.accumulate(map(len, found), initial=at))
            yield [text[a:b] for a, b in itertools.pairwise(ends)]
            at = ends[-1]

    def _cut(self, text: str) -> Iterator[list[str]]:
        at, size = 0, WINDOW
        while at < len(text):
            end = at + size
            if end >= len(text):
                yield self.pattern.findall(text, at)
                return
            found = self.pattern.findall(text, at, end)
            # Matches that end close to the window's end could go on beyond it.
            spent = sum(map(len, found))
            while found and at + spent > end - REACH:
                spent -= len(found.pop())
            if found:
                yield found
                at, size = at + spent, WINDOW
            else:
                size *= 2

    def _learn(self, pieces: set[str]) -> None:
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            self.bytes += len(raw)
            whole = self.vocabulary.ranks.get(raw)
            if whole is not None:
                self.known[piece] = np.array([whole], np.int64)
            elif len(raw) > SHORT:
                self.known[piece] = merge_long(raw, self.vocabulary)
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, rows in classes.items():
            step = max(1, CELLS >> bits)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for (piece, _), ids in zip(part, merge_rows([raw for _, raw in part], self.vocabulary), strict=True):
                    self.known[piece] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of every text; new matches of many short texts are merged together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for row, text in enumerate(texts):
            for found in self.windows(text) if text else ():
                waiting.append((row, found))
                held += len(found)
                if held >= WINDOW >> 2:
                    self._flush(waiting, out)
                    waiting, held = [], 0
        self._flush(waiting, out)
        none = np.zeros(0, np.int64)
        return [np.concatenate(parts) if parts else none for parts in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        fresh: set[str] = set()
        for _, found in waiting:
            fresh.update(found)
        if len(self.known) + len(fresh) > MAX_PIECES or self.bytes > MAX_PIECE_BYTES:
            self.known, self.bytes = {}, 0
        self._learn(fresh - self.known.keys())
        for row, found in waiting:
            if found:
                out[row].append(np.concatenate(list(map(self.known.__getitem__, found))).astype(np.int32))


_WORKER: dict[str, object] = {}


def _vocabulary(key: str, data: bytes) -> Vocabulary:
    """Kept per worker process, as building it takes longer than a batch."""
    if _WORKER.get("key") != key:
        _WORKER.clear()
        _WORKER.update(key=key, vocabulary=Vocabulary(data))
    return _WORKER["vocabulary"]


def _encoder(key: str, data: bytes, pattern: str) -> Encoder:
    vocabulary = _vocabulary(key, data)
    if "encoder" not in _WORKER:
        _WORKER["encoder"] = Encoder(vocabulary, pattern)
    return _WORKER["encoder"]


def _with(batch: pa.RecordBatch, kept: list[str], values: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], names=[*kept, name])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """``docs`` with an array ``ids`` of the text's tokens."""
    data, pattern = rank_file(ranks)
    # The file's size is that of a vocabulary, whatever the corpus.
    shipped = prepared(docs.sparkSession).sparkContext.broadcast(data)
    key = ranks or RANKS
    kept = [c for c in docs.columns if c != ids]
    source = "_text"
    while source in kept:
        source = f"_{source}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shipped.value, pattern)
        for b in batches:
            found = encoder.encode(b.column(source).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
            yield _with(b, kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), ids)

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(source)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that its tokens spell, as a binary column."""
    data, _ = rank_file(ranks)
    shipped = prepared(encoded.sparkSession).sparkContext.broadcast(data)
    key = ranks or RANKS
    kept = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(key, shipped.value)
        for b in batches:
            column = b.column(ids).fill_null(pa.scalar([], b.column(ids).type))
            at = np.asarray(column.offsets)
            tokens = np.asarray(column.values)[at[0] : at[-1]].astype(np.int64)
            raw, places = vocabulary.decode(tokens)
            ends = places[at - at[0]].astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
            yield _with(b, kept, values, out)

    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(out, T.BinaryType())])
    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def encoding_digest(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row of ``docs``."""
    both = decode(encode(docs.select("doc_id", "text"), ranks=ranks).drop("text"), ranks=ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
