"""Batch model-apply: pack sentences, call a function per batch, parse, clean, ask again for what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.similarity import clean_translation, is_untranslated_echo
from quire.operators.sequence import page_batches
from quire.session import stage_table
from quire.sources.records import parse_lines

# A caller gets the (sid, text) pairs of one batch and returns ``sid<TAB>text`` lines.
Caller = Callable[[list[tuple[str, str]]], list[str]]


def offline_caller(pairs: list[tuple[str, str]]) -> list[str]:
    """Deterministic stand-in: marks every sentence as a sample translation."""
    return [f"{sid}\t〔示範譯文〕{text}" for sid, text in pairs]


def call_batches(requests: DataFrame, caller: Caller) -> DataFrame:
    """(paper_id, value) answer lines for requests (paper_id, batch, ord, sid, text).

    A batch is a bounded prompt; batches spread over the cluster and each task streams its own.
    """
    g = requests.groupBy("paper_id", "batch").agg(F.sort_array(F.collect_list(F.struct("ord", "sid", "text"))).alias("b"))
    g = g.select("paper_id", F.transform("b", lambda x: F.struct(x.sid.alias("sid"), x.text.alias("text"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, lines = [], []
            for row in rb.to_pylist():
                for line in caller([(x["sid"], x["text"]) for x in row["b"]]):
                    ids.append(row["paper_id"])
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, rb.schema.field("paper_id").type), pa.array(lines, pa.string())], ["paper_id", "value"])

    return g.mapInArrow(run, f"paper_id {dict(requests.dtypes)['paper_id']}, value string")


def answered(answers: DataFrame, requested: DataFrame, language: Column, last_try: bool) -> DataFrame:
    """(paper_id, sid, t, asked): all that was asked for, with its cleaned answer or, where that is missing, the request.

    A copy of the source only counts on a last try.
    """
    key = ["paper_id", "sid"]
    r = requested.select(*key, F.struct(*requested.columns).alias("asked"))
    j = r.join(answers.select(*key, F.col("text").alias("answer")), key, "left")
    # The cleaned text is made by a generator: as a plain column it would be made again for every use of it.
    j = j.select(*key, "asked", F.explode_outer(F.array(clean_translation(F.col("asked.text"), F.col("answer"), language))).alias("t"))
    good = F.col("t") != ""
    if not last_try:
        good = good & ~is_untranslated_echo(F.col("asked.text"), F.col("t"), language)
    # Of several answers to one sentence the last one counts; their order is not kept by the source.
    one = j.groupBy(*key).agg(F.max(F.when(good, F.col("t"))).alias("t"), F.first("asked").alias("asked"))
    return one.select(*key, "t", F.when(F.col("t").isNull(), F.col("asked")).alias("asked"))


def accepted(answers: DataFrame, requested: DataFrame, language: Column, last_try: bool) -> DataFrame:
    """Cleaned answers to what was asked."""
    return answered(answers, requested, language, last_try).where("t is not null").drop("asked")


def ask_in_rounds(requested: DataFrame, ask: Callable[[DataFrame, int], DataFrame], language: Column, rounds: int = 3) -> DataFrame:
    """(paper_id, sid, t, round): up to ``rounds`` rounds, each only for the sentences still missing.

    ``ask(missing, round)`` returns answer rows (paper_id, sid, text). Nothing is asked when nothing is missing.
    """
    got = None
    missing = requested
    for r in range(rounds):
        # Written, so that no later step or lost executor asks (and pays) again.
        new = stage_table(answered(ask(missing, r), missing, language, last_try=r > 0).withColumn("round", F.lit(r)), "answers")
        missing = new.where("t is null").select("asked.*")
        new = new.where("t is not null").drop("asked")
        got = new if got is None else got.unionByName(new)
        if r + 1 == rounds or missing.isEmpty():
            break
    return got


def translate(sentences: DataFrame, caller: Caller, language: Column, limit: int = 12_000) -> DataFrame:
    """Translate all sentences page batch by page batch, asking again for what is missing: (paper_id, sid, t, round)."""
    batches = page_batches(sentences, limit).select("paper_id", "page", "batch")
    req = sentences.join(batches, ["paper_id", "page"]).select("paper_id", "batch", "ord", "sid", F.regexp_replace("text", r"\s+", " ").alias("text"))

    def ask(missing: DataFrame, _: int) -> DataFrame:
        return parse_lines(call_batches(missing, caller), "paper_id")

    return ask_in_rounds(req, ask, language)


def with_defaults(stored: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Configuration table: stored values over defaults, column by column; stored-only keys stay."""
    values = [c for c in defaults.columns if c != key]
    d = defaults.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    return stored.join(d, key, "full").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in values])
