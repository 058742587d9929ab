"""Near-duplicate documents and vectors, and components, against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import minhash, vectors
from quire.llm.components import components
from tests.llm.conftest import ODD_DOCS


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = minhash.words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    u = Union()
    for k, (i, s) in enumerate(sets):
        u.find(i)
        for j, z in sets[:k]:
            if s and z and 100 * len(s & z) >= 75 * len(s | z):
                u.join(i, j)
    return {i: (len(s), u.find(i)) for i, s in sets}


def near_rows():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40))
    rows, common = [], [word() for _ in range(30)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return words

    for _ in range(12):
        original = [word() for _ in range(rng.choice([6, 20, 80, 200]))] + common * rng.randrange(2)
        rows += [" ".join(edited(original, k % 6)) for k in range(rng.choice([1, 3, 25]))]
        rows += [" ".join(original).upper().replace(" ", "\n ")] * rng.randrange(3)
    rows += ["a b c d", "A  b c d", "a b c", "a b c d e", "a b c d e f", "x " * 4, "x " * 400, "x " * 401, None, "", "é b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_near_duplicates_equal_brute_force(spark, docs_of, partitions):
    rows = near_rows()
    want = brute_components(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = minhash.near_duplicates(docs_of(rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_chain(docs_of):
    """Each text is near the next only: the component is the whole chain, which no pivot sees at once."""
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - k, " ".join(words[k * 12 : k * 12 + 120])) for k in range(20)]
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(rows)).collect()} == want
    assert len({c for _, c in want.values()}) == 1


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(ODD_DOCS)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (None, 0, None, True), (7, 1, 7, True), (8, 1, 8, True)} <= got
    assert minhash.near_duplicates(no_docs).count() == 0


def test_signature_is_a_shifted_permutation():
    first, windows = minhash.permutations()
    assert sorted(first) == list(range(minhash.UNIVERSE))
    second = windows[:, 0]
    assert (windows[:, 5] == np.roll(second, -5)).all()
    a, b = (np.unique(minhash.mix(np.arange(s, s + 4000, dtype=np.uint64))) for s in (0, 400))
    share = np.mean(minhash.signature(a) == minhash.signature(b))
    assert abs(share - 3600 / 4400) < 0.12


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    edges += [(7, 7), (None, 3), (8, None)]
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    want = {x: u.find(x) for x in u.up}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    unit = []
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None))
    u, n = Union(), [0] * len(unit)
    for k, (i, a) in enumerate(unit):
        u.find(i)
        for m, (j, b) in enumerate(unit[:k]):
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95:
                n[k] += 1
                n[m] += 1
                u.join(i, j)
    return sorted((i, n[k], u.find(i)) for k, (i, _) in enumerate(unit))


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * rng.choice([0, 0.05, 0.3])).tolist() for _ in range(rng.integers(1, 40))]
    rows += [[1.0] + [0.0] * 7] * 30 + [[3.0] + [0.0] * 7, None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 0.0], [1e-300] * 8]
    rows = list(enumerate(rows))
    monkeypatch.setattr(vectors, "ROWS_PER_PIVOT", 25)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    table = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<double>, unit string, vid int").repartition(4)
    got = vectors.near_vectors(table).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vectors_without_and_with_repeated_ids(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.1]), (4, [1.0, 0.1]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.near_vectors(table).collect()), key=str)
    assert got == sorted([(None, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True)], key=str)


def test_vectors_with_negative_ids(spark):
    base, other = [1.0, 0.0, 0.1], [0.0, 1.0, 0.2]
    rows = [(-5, base), (3, [1.0, 0.0, 0.11]), (-7, other), (-6, [0.0, 1.0, 0.21]), (None, [0.0, 1.0, 0.22])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(-5, 1, -5, True), (3, 1, -5, False), (-7, 2, -7, True), (-6, 2, -7, False), (None, 2, -7, True)}
