"""Near-duplicate documents by circulant MinHash, bands, and exact Jaccard on full shingle sets.

Two permutations make the whole signature: a shingle's position under the first is where
a window of the second starts, and coordinate ``k`` is the minimum over all shingles of
the second permutation shifted circularly by ``k``. A document's signature is thus the
minimum of as many contiguous windows as it has shingles. 128 coordinates in 32 bands of
4 miss a pair of similarity 0.75 with probability 5e-6.

Documents with equal sets are one class from the start. Classes that share a band key
meet in its bucket, but a bucket never emits its pairs. First its members meet one pivot,
the member that shares most buckets, as copies resemble their original most; verified
pairs become components. Buckets whose other members are not all in one component are
then worked through whole: they are cut into blocks of bounded size, every pair of blocks
is one group, compares its sets by counting common shingles as matrix products, and
returns a spanning forest of its links. Every pair of a bucket is thus compared or
already connected, so no component is missed, and buckets of any size are spread over
all tasks.

Rows: one result per document row. Null, empty and blank texts have no shingles and no
links. A null id has no links and its document is kept. Rows that repeat an id get the
component of their own text. Whole texts are read; other columns are not.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared
from quire.llm.components import components, forest
from quire.session import stage_table

WORDS = 5  # words in a shingle
PERCENT = 75  # least similarity, in hundredths
UNIVERSE = 1 << 20  # positions that shingles hash to
BANDS, ROWS = 32, 4
BLOCK_SHINGLES, BLOCK_ROWS = 150_000, 1024  # of a block of a bucket, about
COLUMNS = 2048  # shingles that are counted at once
SEED = 20_240_607

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MAX_CACHED_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgotten when there are many, as memory is bounded and words are not."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = mix(s ^ (h[i : n - k + 1 + i] * _ODD[i]))
    return np.unique(s)


@functools.lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of the second, circularly extended."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    k = BANDS * ROWS
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, windows = permutations()
    at = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = windows[at[0]].copy()
    for i in range(0, len(at), 2048):
        np.minimum(out, windows[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * _ODD[4] ^ (s[:, i] + np.uint64(1)) * _ODD[i])
    return key.view(np.int64)


def _digest() -> Callable[..., tuple]:
    hashes = WordHashes()

    def row(text):
        s = shingle_set(words_of(text), hashes)
        if not len(s):
            return 0, None, None, []
        with np.errstate(over="ignore"):
            key1, key2 = int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s).sum(dtype=np.uint64).view(np.int64))
        return len(s), key1, key2, band_keys(signature(s))

    return row


def _sets() -> Callable[..., tuple]:
    hashes = WordHashes()
    return lambda text: (shingle_set(words_of(text), hashes).view(np.int64),)


DIGEST = [
    T.StructField("n_shingles", T.LongType()), T.StructField("key1", T.LongType()), T.StructField("key2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the full sets reach the similarity."""
    ids = stage_table(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ids")
    own = sets.join(ids, "cid", "left_semi")
    left = own.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = own.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("common"), "sa", "sb")
        .select("a", "b", (100 * F.col("common") >= PERCENT * union).alias("linked"))
    )


def linked_classes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, component)`` of the classes ``(cid, n_shingles, bands)`` that are linked with another one."""
    banded = classes.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    items = stage_table(banded.join(crowded, "key"), "buckets")
    # The member that meets most others is a good first pivot: copies resemble their original most.
    items = stage_table(items.join(items.groupBy("cid").agg(F.sum("members").alias("met")), "cid"), "buckets")
    ids = stage_table(items.select("cid").distinct(), "ids")
    wanted = texts.join(ids, texts["doc_id"] == ids["cid"], "left_semi").select(F.col("doc_id").alias("cid"), "text")
    sets = add_columns(wanted, ["text"], [T.StructField("shingles", T.ArrayType(T.LongType()))], _sets).drop("text")
    sets = stage_table(sets.where(F.size("shingles") > 0), "sets")

    first = items.groupBy("key").agg(F.max_by("cid", F.struct("met", -F.col("cid"))).alias("pivot"))
    items = stage_table(items.join(first, "key").select("key", "cid", "n", "pivot"), "members")
    pn = items.where("cid = pivot").select(F.col("key").alias("k"), F.col("n").alias("pn"))
    met = (
        items.where("cid <> pivot").join(pn, F.col("key") == F.col("k"))
        .where(100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn"))
        .select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).distinct()
    )
    links = stage_table(verified(stage_table(met, "pairs"), sets).where("linked").select("a", "b"), "verified")
    labels = components(links)

    rest = items.where("cid <> pivot").join(labels, F.col("cid") == F.col("node"), "left")
    rest = rest.select("key", "cid", "n", F.coalesce("component", "cid").alias("component"))
    split = rest.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"),
        F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("cid", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)],
    ).where("lo <> hi")
    # Texts that share several bands fill several buckets alike; one of those is enough.
    split = split.groupBy("size", "x1", "x2").agg(F.min(F.struct("key", "blocks")).alias("b")).select("b.key", "b.blocks")
    opened = stage_table(rest.join(split, "key").select("key", "blocks", "cid", "component"), "open")
    if opened.isEmpty():
        return labels
    more = stage_table(block_links(opened, sets), "links")
    return components(links.unionByName(more))


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what the pairs within a bucket connect; ``members`` (key, blocks, cid, component)."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "cid", "component", "block", F.least("block", "other").alias("l"), F.greatest("block", "other").alias("r"))
    # The set travels once to the member's rows and with each of them to its pair of blocks.
    own = sets.join(members.select("cid").distinct(), "cid", "left_semi")
    return dealt.join(own, "cid").groupBy("key", "l", "r").applyInArrow(_block_links, "a long, b long")


def _block_links(group: pa.Table) -> pa.Table:
    l, r = group.column("l")[0].as_py(), group.column("r")[0].as_py()
    cid, comp, block = (np.asarray(group.column(c)) for c in ("cid", "component", "block"))
    lists = group.column("shingles").combine_chunks()
    ends = np.asarray(lists.offsets)
    sizes, values = np.diff(ends), np.asarray(lists.values)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(cid)), sizes)
    left, right = np.flatnonzero(block == l), np.flatnonzero(block == r)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return none
    place = np.zeros(len(cid), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    # Shingles that both sides have, as columns; each side's entries in order of columns.
    both, columns = np.unique(values, return_inverse=True)
    in_left, in_right = (np.isin(block[row], x) for x in (l, r))
    shared = np.zeros(len(both), bool)
    shared[columns[in_left]] = True
    other = np.zeros(len(both), bool)
    other[columns[in_right]] = True
    shared &= other
    number = np.cumsum(shared) - 1
    sides = []
    for side in (in_left, in_right):
        at = np.flatnonzero(side & shared[columns])
        at = at[np.argsort(number[columns[at]], kind="stable")]
        sides.append((number[columns[at]], place[row[at]]))
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        tables = []
        for (column, where), n in zip(sides, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(column, [start, start + COLUMNS])
            t = np.zeros((n, COLUMNS), np.float32)
            t[where[i:j], column[i:j] - start] = 1
            tables.append(t)
        common += tables[0] @ tables[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = (100 * common >= PERCENT * union) & (comp[left][:, None] != comp[right][None, :])
    i, j = np.nonzero(linked)
    edges = forest(cid[left[i]], cid[right[j]])
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]}) if len(edges) else none


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs`` (doc_id, text)."""
    prepared(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    rows = stage_table(add_columns(texts, ["text"], DIGEST, _digest).drop("text"), "digests")
    whole = ["n_shingles", "key1", "key2"]
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = stage_table(named.groupBy(*whole).agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands")), "classes")
    labels = linked_classes(classes, texts)
    merged = classes.select(*whole, "cid").join(labels, F.col("cid") == F.col("node"), "left")
    # Only classes that hold another row, or that are linked, are joined back; all other rows are their own.
    merged = merged.select(*whole, F.coalesce("component", "cid").alias("component"))
    found = named.select("doc_id", *whole).join(merged, whole)
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return (
        found.select("doc_id", "n_shingles", "component").unionByName(alone)
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
    )
