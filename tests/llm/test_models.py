"""Importance resampling and language-model scores against brute force and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import importance, lm
from tests.llm.conftest import ODD_DOCS

SF = "/root/testdata/sf0.001"


def brute_scores(rows, strength):
    c1, c2, seen = Counter(), Counter(), []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        seen.append((i, held, w))
        if not held:
            c1.update(w)
            c2.update(zip(w, w[1:], strict=False))
    total, distinct = sum(c1.values()), len(c1)
    out = []
    for i, held, w in seen:
        base = score = 0.0
        for k, x in enumerate(w):
            p = (c1[x] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            score += math.log10(p if k == 0 else (c2[w[k - 1], x] + strength * p) / (c1[w[k - 1]] + strength))
        out.append((i, held, len(w), sum(c1[x] > 0 for x in w), total, base, score))
    return out


def same_scores(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[5]))
    got, want = order(map(tuple, got)), order(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-12)


def test_scores_equal_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lm, "BATCH_CHARS", 40_000)
    monkeypatch.setattr(lm, "SHARD_GRAMS", 20_000)
    same_scores(lm.score_documents(docs).collect(), brute_scores(rows, lm.STRENGTH))


def test_scores_of_odd_rows(odd_docs, no_docs):
    same_scores(lm.score_documents(odd_docs).collect(), brute_scores(ODD_DOCS, lm.STRENGTH))
    assert lm.score_documents(no_docs).count() == 0


def test_states_are_distributions():
    """Arc weights and the failure arc's share of the rest sum to one in every state."""
    grams = lm.BatchGrams(["a b a c a b", "b a"], 2)
    counts = [np.bincount(i[i >= 0]) for i in grams.index]
    total, distinct = int(counts[0].sum()), len(counts[0])
    automaton = lm.Automaton(counts, total, distinct, 7.0)
    unseen = 0.5 / (total + 0.5 * (distinct + 1))
    assert automaton.root.sum() + unseen == pytest.approx(1)
    for c, followers in ((4, [3, 1, 0, 0]), (3, [2, 0, 1, 0])):
        lower = automaton.root
        assert sum((f + 7 * p) / (c + 7) for f, p in zip(followers, lower, strict=True)) + 7 * unseen / (c + 7) == pytest.approx(1)


def test_a_third_order_helps_on_copies(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog and then it rests") for i in range(40)], "doc_id long, text string")
    two, three = (lm.score_documents(docs, order=n, strength=1.0).agg(F.sum("score")).first()[0] for n in (2, 3))
    assert three > two


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 3 <> 0")
    got = importance.resample(docs, known).join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.98 and share[0] < 0.05


def test_weights_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    features = importance.make_features()
    bag = {r.doc_id: features(r.text) for r in docs.collect()}
    target = {r.doc_id for r in importance.labelled(labels).where("good and fold = 0").collect()}
    raw, good = Counter(), Counter()
    for i, f in bag.items():
        raw.update(f.tolist())
        if i in target:
            good.update(f.tolist())
    n, m = sum(raw.values()), sum(good.values())
    rows = importance.resample(docs, labels).collect()
    for r in rows:
        f = bag[r.doc_id].tolist()
        want = sum(math.log((good[x] + importance.PRIOR) / (raw[x] * m / n + importance.PRIOR)) for x in f)
        assert r.n_features == len(f) and r.log_weight == pytest.approx(importance.LENGTH * want / len(f) if f else 0.0, abs=1e-3)
    # The draw is the top k by noisy weight.
    kept = sorted((r.key for r in rows if r.kept), reverse=True)
    assert kept and min(kept) >= max((r.key for r in rows if not r.kept), default=-math.inf)


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    keys = np.round(rng.normal(size=500), 1).tolist() + [0.5] * 100
    table = spark.createDataFrame([(float(k), -i) for i, k in enumerate(keys)], "key double, tie long")
    order = sorted(((k, -i) for i, k in enumerate(keys)), reverse=True)
    for k in (1, 2, 77, 300, 599, 600):
        assert importance._kth_largest(table, k) == order[k - 1]


def test_odd_rows_are_kept(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = importance.resample(odd_docs, labels).collect()
    assert len(rows) == len(ODD_DOCS)
    assert all(r.log_weight == 0.0 and r.n_features == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert importance.resample(odd_docs, labels.limit(0)).where("kept").count() == len(ODD_DOCS)
    assert importance.resample(no_docs, labels).count() == 0
    drawn = importance.keep_drawn(odd_docs, labels.limit(0))
    assert drawn.columns == odd_docs.columns and drawn.where("key = 'extra' and kept = 'extra'").count() == len(ODD_DOCS)
