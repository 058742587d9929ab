"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Two words are near if one inserted, deleted or replaced code point makes one the other:
then their common prefix and common suffix together reach the longer length less one. A
tile holds the words of two blocks as padded code-point matrices, aligned left for the
prefix and right for the suffix, and compares all of one block with all of the other.

Which blocks meet follows from the same lengths. With ``s`` half the shorter word's
length, an edit after the first ``s`` code points leaves those alone, and an edit before
leaves all after them alone. So every word stands under the two halves it has as the
shorter word of a pair and the two it has as the longer one, and only words that share a
half can be near. The words of a half are dealt into blocks of bounded size, and every
pair of blocks is a tile; a pair that shares both halves counts under the first. A tile
returns one row per word with a near word, never the pairs: how many there are and the
most frequent one. These rows are added up per word.

Forms are followed to the last by doubling: every round joins a word's root so far with
the root of that root, so chains of any length take a logarithm of rounds.

Rows: null and empty texts have no words; whole texts are read; repeated rows count each;
a null id counts as an empty one in the hash; an empty table gives no words; other
columns are not read. Ties of frequency go to the smallest word in code-point order.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import prepared
from quire.session import stage_table

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
RATIO = 5
#: One word in so many, by hash, loses a code point.
DAMAGE = 199
#: Words of a block of a half.
BLOCK = 1024
#: Rows of a tile that are compared at once: cells are rows x words of the other block x length.
CELLS = 1 << 22
#: What a tile is known by, and up to how many words small ones are compared in one matrix.
TILE = ("class", "kind", "half", "l", "r")
PACK = 64
#: Distinct words that a task counts before it hands them on.
HELD = 300_000


def damaged(doc_id: str, run: str) -> str:
    """The run, less one code point where the hash says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for r in range(b.num_rows):
                text = texts[r].as_py()
                if not text:
                    continue
                # Only A-Z are lower-cased.
                found = Counter(pattern.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                start = zlib.crc32(f"{ids[r].as_py() or ''}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def halves(word: Column) -> Column:
    """The halves a word stands under: ``(class, kind, half)``; the class is the shorter word's length, kind 0 a prefix."""
    n = F.length(word)
    keys = []
    for shorter in (n, n - 1):
        s = F.floor(shorter / 2).cast("int")
        keys.append(F.struct(shorter.alias("class"), F.lit(0).alias("kind"), F.substring(word, F.lit(1), s).alias("half")))
        keys.append(F.struct(shorter.alias("class"), F.lit(1).alias("kind"), F.substring(word, n - (shorter - s) + 1, shorter - s).alias("half")))
    return F.array(*keys)


def matrices(words: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and right, and the lengths; ``pad`` fills the rest and is no code point."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    column = np.arange(width)
    inside = column < lengths[:, None]
    left, right = np.full((2, len(words), width), pad, np.int32)
    left[inside] = flat
    right[inside[:, ::-1]] = flat
    return left, right[:, ::-1], lengths


def near_tile(rows: list[str], cols: list[str], kind: int, shorter: int) -> np.ndarray:
    """Which of ``rows`` is near which of ``cols``; words of the class ``shorter``, one of each pair of just that length."""
    width = shorter + 2  # a column beyond the longest ends every prefix
    a_left, a_right, a_n = matrices(rows, width, -1)
    b_left, b_right, b_n = matrices(cols, width, -2)
    out = np.zeros((len(rows), len(cols)), bool)
    step = max(1, CELLS // (len(cols) * width))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        prefix = (a_left[part, None, :] != b_left[None, :, :]).argmax(axis=2)
        suffix = (a_right[part, None, :] != b_right[None, :, :]).argmax(axis=2)
        longer = np.maximum(a_n[part, None], b_n[None, :])
        both = a_n[part, None] + b_n[None, :]
        # Equal words share all; two words of the longer length belong to the next class.
        near = (prefix + suffix >= longer - 1) & (both <= 2 * shorter + 1) & ((prefix < longer) | (both % 2 == 1))
        # A pair that shares both halves counts under the prefix.
        out[part] = near if kind == 0 else near & (prefix < shorter // 2)
    return out


def _summary(rows: list[str], cols: list[str], n: np.ndarray, near: np.ndarray, out: list[tuple]) -> None:
    """A row per word with near ones; ``cols`` stand in order of preference, and so do their counts ``n``."""
    total = near.sum(axis=1)
    best = near.argmax(axis=1)
    out += [(rows[i], int(total[i]), int(n[best[i]]), cols[best[i]]) for i in np.flatnonzero(total)]


def _summaries(out: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*out, strict=True)]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def _changes(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in columns:
        values = table.column(c).combine_chunks()
        new |= np.asarray(pc.not_equal(values[1:], values[:-1]))
    return np.flatnonzero(new) + 1


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n_near, best_n, best)`` of the words of every tile, as far as the tile knows.

    Rows come in order of tile, frequency and word. Small tiles of one class and kind are
    compared in one matrix, in which only words of the same tile count.
    """
    rest: list[pa.RecordBatch] = []
    for last in (False, True):
        for b in batches if not last else (None,):
            if b is not None:
                rest.append(b)
            if not rest:
                continue
            table = pa.Table.from_batches(rest)
            starts = _changes(table, TILE)
            # The last tile may go on in the next batch.
            end = table.num_rows if last else (int(starts[-1]) if len(starts) else 0)
            if not end:
                continue
            rest = [] if last else table.slice(end).to_batches()
            out: list[tuple] = []
            whole = table.slice(0, end)
            for at, to in itertools.pairwise([0, *_packs(whole, starts[starts < end]), end]):
                _compare(whole.slice(at, to - at), out)
            if out:
                yield _summaries(out)


def _packs(table: pa.Table, starts: np.ndarray) -> list[int]:
    """Where to cut the rows into packs: of whole tiles, one class and kind each, small ones together."""
    coarse = set(_changes(table, ("class", "kind")).tolist())
    blocks = np.asarray(table.column("blocks"))
    cuts: list[int] = []
    begin = 0
    for at, to in itertools.pairwise([0, *starts.tolist(), table.num_rows]):
        if at and (at in coarse or blocks[at] > 1 or blocks[at - 1] > 1 or to - begin > PACK):
            cuts.append(at)
            begin = at
    return cuts


def _compare(pack: pa.Table, out: list[tuple]) -> None:
    kind, shorter, l, r = (pack.column(c)[0].as_py() for c in ("kind", "class", "l", "r"))
    words, n = pack.column("word").to_pylist(), np.asarray(pack.column("n"))
    if l != r:
        block = np.asarray(pack.column("block"))
        first, second = np.flatnonzero(block == l), np.flatnonzero(block == r)
        rows, cols = [words[i] for i in first], [words[i] for i in second]
        if rows and cols:
            near = near_tile(rows, cols, kind, shorter)
            _summary(rows, cols, n[second], near, out)
            _summary(cols, rows, n[first], near.T, out)
        return
    tile = np.zeros(len(words), np.int64)
    tile[_changes(pack, TILE)] = 1
    tile = np.cumsum(tile)
    _summary(words, words, n, near_tile(words, words, kind, shorter) & (tile[:, None] == tile[None, :]), out)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of every word of ``words`` (word, n; distinct) that has a near one."""
    prepared(words.sparkSession)
    held = words.select("word", "n", F.explode(halves(F.col("word"))).alias("k")).select("word", "n", "k.class", "k.kind", "k.half")
    key = ["class", "kind", "half"]
    # Halves of a single word, or without a word of the shorter length, hold no pair.
    shorts = F.count_if(F.length("word") == F.col("class"))
    sizes = held.groupBy(*key).agg(F.count("*").alias("size"), shorts.alias("shorts")).where("size > 1 and shorts > 0")
    sizes = sizes.select(*key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = held.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, "word", "n", "blocks", "block", F.least("block", "other").alias("l"), F.greatest("block", "other").alias("r"))
    tiled = dealt.repartition(*TILE).sortWithinPartitions(*TILE, F.col("n").desc(), "word")
    tiles = tiled.mapInArrow(_tiles, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every row of ``forms`` (word, form): forms are followed to a word without one."""
    reached = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = reached.join(further, F.col("root") == F.col("at"), "left")
        if joined.where("at is not null").isEmpty():
            return reached
        reached = stage_table(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs`` (doc_id, text)."""
    prepared(docs.sparkSession)
    words = stage_table(word_counts(docs), "words")
    near = words.join(near_words(words), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    table = stage_table(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    ), "near")
    last = roots(table.where("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
