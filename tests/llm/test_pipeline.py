"""The corpus pipeline and the registered queries."""

import pytest

import corpus_pipeline
from quire.llm import load
from quire.llm.minhash import words_of
from quire.session import stage_table
from tests.llm.conftest import ODD_DOCS
from tests.llm.test_dedup import brute_components
from tests.llm.test_scans import brute_secrets
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage_table(stage(spark, kept[-1], SF), name.split()[0]))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].schema == docs.schema
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    known = [i for i in rows[0] if i in quality]
    assert sum(i in rows[1] for i in known if quality[i]) >= 0.98 * sum(quality[i] for i in known)
    assert sum(i in rows[1] for i in known if not quality[i]) <= 1
    want = brute_components([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, c) in want.items() if i == c}
    leaks = {i for i, r in rows[2].items() if any(t in " ".join((r.text or "").lower().split()) for t in items)}
    assert leaks <= set(rows[2]) - set(rows[3]) and len(rows[2]) - len(rows[3]) <= len(leaks) + 2
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert r.n_chars == len(r.text) and not brute_secrets(r.text)
        assert r.text == rows[3][i].text or brute_secrets(rows[3][i].text)
    assert {i: r["size"] for i, r in rows[5].items()} == {i: len(words_of(r.text)) for i, r in rows[4].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_documents(spark, odd_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    if k < 4:
        assert out.columns == odd_docs.columns
        # A copy and a repeated row of it go; all other odd rows stay.
        gone = 0 if k != 1 else sum(i == 5 for i, _ in ODD_DOCS)
        assert out.where("key = 'extra' and bands = 'extra'").count() == len(ODD_DOCS) - gone if k else out.count() <= len(ODD_DOCS)
    else:
        assert out.count() == len(ODD_DOCS)
    assert stage(spark, no_docs, SF).count() == 0


@pytest.mark.parametrize("name", [*QUERIES])
def test_queries(spark, name):
    ok, rows, _, note = compare(spark, duck(SF), SF, QUERIES[name], ORACLES.get(name))
    assert ok is not False, note
    assert rows
