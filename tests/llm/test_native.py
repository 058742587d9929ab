"""Source mixing and decontamination: results, and that their plans hold no Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing
from tests.llm.conftest import ODD_DOCS

SF = "/root/testdata/sf0.01"


def brute_targets(sizes, cap=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, room = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and room:
        whole = sum(weight[s] for s in room)
        for s in room:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(room):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                room.discard(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1000}, {"b": 1, "a": 10, None: 7}, {"a": 0, "b": 50}, {"é": 5, "z": 5, "Z": 5, None: 1000}, {"a": 7},
    {f"s{i}": (i * 37 % 11) ** 3 for i in range(25)}, {"a": 0, "b": 0},
])
def test_targets(spark, sizes):
    rows = [(s, n) for s, total in sizes.items() for n in (total // 3, total - total // 3)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 256):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2))).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_mix_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_report(docs).collect()
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, (t, s) in text.items():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert len(rows) == len(text)
    for r in rows:
        t, s = text[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(taken[s] == pytest.approx(want[s], rel=0.02, abs=100) for s in want)
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_contents_hold_what_is_taken(docs_of):
    docs = docs_of([(i, f"w{i} " * (i % 90)) for i in range(150)])
    mix = mixing.build_mix(docs, block=8, slots=64)
    pieces = mix.contents().collect()
    taken = defaultdict(int)
    for p in pieces:
        assert 0 < p.words <= 8 and p.word + p.words <= p.doc_id % 90
        taken[p.doc_id] += p.words
    assert {r.doc_id: r.taken for r in mix.taken().collect()} == {i: taken[i] for i in range(150)}
    filled = defaultdict(int)
    for p in pieces:
        filled[p.sid, p.slot] += p.words
    assert max(filled.values()) <= 8


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == len(ODD_DOCS) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_report(no_docs).count() == 0


ITEMS = [
    (1, "a train leaves the station with 45 people and after 3 stops it has 12 people left on board"),
    (2, "this is a plain sentence without any slots in it that is long enough to have windows"),
    (3, "only four words here"), (4, None), (5, ""), (None, "nobody can name this item although it is long enough to match something"),
    (6, "on the table lie 5 apples and 5 pears and 7 plums so how many fruits are on it"),
]
PASSAGES = [
    (10, "intro words. " + ITEMS[0][1] + " and more", {1}),
    (11, "a train leaves the station with 46 people and after 9 stops it has 17 people left on board", {1}),
    (12, "a train leaves the station with", set()),
    (13, "X " + ITEMS[1][1].upper(), {2}),
    (14, "well only four words here now", {3}), (15, "only four other words here", set()),
    (16, "on the table lie 9 apples and 9 pears and 2 plums so how many fruits are on it", {6}),
    (17, "on the table lie 9 apples and 8 pears and 2 plums so how many fruits are on it", set()),
    (18, ITEMS[1][1] + "\n" + ITEMS[0][1], {1, 2}), (19, None, set()), (20, "", set()), (None, ITEMS[1][1], set()),
    (21, ITEMS[5][1], set()), (22, ("filler " * 5000) + ITEMS[1][1], {2}), (23, "this is a plain sentence without other things to say", set()),
]


def test_leaks(spark, docs_of):
    docs = docs_of([(i, t) for i, t, _ in PASSAGES] + [(10, PASSAGES[0][1])])
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    got = defaultdict(set)
    for r in decontaminate.find_leaks(docs, items).collect():
        assert r.item_id not in got[r.doc_id] and r.coverage >= decontaminate.COVERAGE
        got[r.doc_id].add(r.item_id)
    assert {i: s for i, s in got.items() if s} == {i: s for i, _, s in PASSAGES if s}
    kept = decontaminate.drop_leaked(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, s in PASSAGES if not s}
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


CHANGED = "a train leaves the station with 46 people and after 9 stops it has 17 people left on board"
COPIES = [
    (30, ITEMS[0][1] + " . " + CHANGED, {1}), (31, CHANGED + " and " + CHANGED.replace("46", "50").replace("17", "2"), {1}),
    (32, ITEMS[0][1] + " . later on it has 99 people left on board", {1}), (33, ITEMS[6][1] + " . " + ITEMS[6][1].replace("5 pears", "8 pears"), {6}),
    # Words put into both copies; one value for two in every copy.
    (34, " filler ".join(" ".join(t.split()[i : i + 10] if i < 10 else t.split()[10:]) for t in (ITEMS[0][1], CHANGED) for i in (0, 10)), {1}),
    (35, " and ".join("on the table lie %d apples and %d pears and 2 plums so how many fruits are on it" % x for x in ((9, 8), (7, 6))), set()),
]


def test_an_item_twice_with_different_values(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of([(i, t) for i, t, _ in COPIES]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted((i, k) for i, _, s in COPIES for k in s)


NAMED_ITEMS = [
    (1, "Anna has 5 apples and 3 pears"), (2, "What is the sum of 5 and 7"), (3, "the ferry leaves Oslo at 9 hours and then Anna, Bob, Carl and Dora meet Emil near Bergen at night"),
    (4, "the long ferry line from Oslo goes slowly to Bergen while\nAnna sleeps on the upper deck all night"),
]
NAMED = [
    (40, "Bob has 6 apples and 2 pears", {1}), (41, "so it ends. Bob has 6 apples and 2 pears. more", {1}), (42, "today Bob has 6 apples and 2 pears", {1}),
    (43, "he asked What is the sum of 5 and 7", {2}), (44, "first, What is the sum of 8 and 9", {2}), (45, NAMED_ITEMS[2][1].lower(), {3}), (46, NAMED_ITEMS[2][1].upper(), {3}),
    (47, NAMED_ITEMS[2][1].replace(" ", "\n"), {3}), (48, NAMED_ITEMS[3][1].replace("\n", " ").replace("Anna", "Zoe"), {4}), (49, NAMED_ITEMS[2][1].replace(" Anna", "\u00a0\tAnna"), {3}),
    (50, "Bob has 6 plums and 2 figs", set()), (51, "WE HAVE SO MANY WORDS IN CAPITALS HERE THAT NOTHING IS FIXED", set()), (52, "he asked What was the sum of 5 and 7", set()),
]


def test_names_anywhere_and_in_any_case(spark, docs_of):
    items = spark.createDataFrame(NAMED_ITEMS, "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of([(i, t) for i, t, _ in NAMED]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted((i, k) for i, _, s in NAMED for k in s)


def test_leaks_in_the_given_documents(spark):
    """Documents that hold a benchmark text word for word are found; what is found shares most words with its item."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    text = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs.collect()}
    item = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(i, k) for i, t in text.items() for k, s in item.items() if s in t} <= found
    for i, k in found:
        words = item[k].split()
        assert sum(" ".join(words[j : j + 4]) in text[i] for j in range(len(words) - 3)) > 0.2 * len(words)


def test_the_gate_loses_no_match(spark, docs_of, monkeypatch):
    """With a gate of one slot everything passes; the results are the same, also for items of one and two words."""
    docs = docs_of([(i, t) for i, t, _ in PASSAGES + COPIES + NAMED] + [(900 + k, "x " * k + "lone pair x") for k in range(9)])
    items = spark.createDataFrame([*ITEMS, *((10 + i, t) for i, t in NAMED_ITEMS), (30, "lone"), (31, "lone pair"), (32, "pair x y")], "item_id long, text string")
    rows = []
    for gate in (decontaminate.GATE, 1):
        monkeypatch.setattr(decontaminate, "GATE", gate)
        rows.append(sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())))
    assert rows[0] == rows[1] and {(900, 30), (905, 31)} <= {r[:2] for r in rows[0]} and 32 not in {r[1] for r in rows[0]}


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_source_mix"])
def test_no_python_in_the_plan(spark, name):
    from quire.llm.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("sizes", [[1, 2, 3, 5, 7, 8], [7], [8], [4, 8]])
def test_the_gate_loses_no_window(spark, sizes):
    """Windows of all sizes that the benchmark has are the same with the gate and without."""
    rng = random.Random(3)
    words = ["tide", "Ebb", "in", "the", "12", "km", "Oslo", "slack,"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    items = [some(25) for _ in range(12)]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    docs = frame([f"{some(12)} {rng.choice(items)} {some(12)}" for _ in range(100)])
    items = frame(items)
    items = items.select("id", decontaminate.template_words(F.col("text")).alias("words"))
    docs = docs.select("id", decontaminate.template_words(F.col("text")).alias("words"))
    gate = decontaminate.gate_of(items.select(F.explode(decontaminate.word_pairs(F.col("words"))).alias("x")))
    gate_1 = decontaminate.gate_of(items.select(F.explode(F.transform("words", lambda w: F.array(w))).alias("w")).select(F.explode(decontaminate.word_pairs(F.col("w"))).alias("x")))
    gate = bytes(a | b for a, b in zip(gate, gate_1, strict=True))
    cut = lambda d, g: decontaminate._hashes(d.select("id", F.explode(decontaminate.windows(F.col("words"), sizes, g)).alias("w"))).select("id", "pos", "size", "h")
    own = cut(items, None).select("size", "h").distinct()
    met = [sorted(map(tuple, cut(docs, g).join(own, ["size", "h"], "left_semi").distinct().collect())) for g in (None, gate)]
    assert met[0] == met[1] and len(met[0]) > 0
