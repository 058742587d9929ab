"""What a model leaves out is asked again, up to two times, and nothing else is."""

from pyspark.sql import functions as F

from quire.operators import model_apply as P


def first_only(pairs):
    return [f"{sid}\t譯文 {len(pairs)}" for sid, _ in pairs[:1]]


def everything(pairs):
    return [f"{sid}\t譯文" for sid, _ in pairs]


def rows(spark):
    text = "Tides rise in the harbour."
    return spark.createDataFrame([(p, 0, f"1.{i}", i, text) for p in (1, 2) for i in range(1, 5)], "paper_id long, page long, sid string, ord long, text string")


def test_missing_sentences_are_asked_again(spark):
    got = {(r.paper_id, r.sid): (r.t, r["round"]) for r in P.translate(rows(spark), first_only, F.lit("中文")).collect()}
    want = {f"1.{i + 1}": (f"譯文 {4 - i}", i) for i in range(3)}
    assert got == {(p, s): w for p in (1, 2) for s, w in want.items()}


def test_nothing_is_asked_when_nothing_is_missing(spark, monkeypatch):
    staged = []
    stage = P.stage_table
    monkeypatch.setattr(P, "stage_table", lambda df, name: (staged.append(name), stage(df, name))[1])
    assert P.translate(rows(spark), everything, F.lit("中文")).count() == 8
    assert staged == ["answers"]
