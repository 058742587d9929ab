"""Operators over the reading order of one document (bounded by the document's length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import let



def in_order():
    """Reading order of one paper."""
    return Window.partitionBy("paper_id").orderBy("ord")


def number_per_page(sentences: DataFrame) -> DataFrame:
    w = Window.partitionBy("paper_id", "page").orderBy("ord")
    return sentences.withColumn("n", F.row_number().over(w))


def long_runs(sentences: DataFrame, flag: Column, least: int = 3) -> DataFrame:
    """Mark rows that lie in a run of at least ``least`` consecutive flagged rows (column ``in_run``)."""
    flagged = sentences.withColumn("_f", flag)
    island = F.row_number().over(in_order()) - F.row_number().over(Window.partitionBy("paper_id", "_f").orderBy("ord"))
    run = Window.partitionBy("paper_id", "_f", "_island")
    return (
        flagged.withColumn("_island", island)
        .withColumn("in_run", F.col("_f") & (F.count("*").over(run) >= least))
        .drop("_f", "_island")
    )


def soon(flag: Column, rows: int = 8) -> Column:
    """The flag holds on one of the next ``rows`` rows of the paper."""
    return F.coalesce(F.max(flag).over(in_order().rowsBetween(1, rows)), F.lit(False))


def pack(items: Column, limit: int, adjacent: bool) -> Column:
    """Greedy packing of ordered ``ARRAY<STRUCT<k,size>>`` into numbered batches.

    A batch closes when the next item would push it over ``limit``, or (``adjacent``)
    when the next key does not follow the last one. Returns ``ARRAY<STRUCT<k,size,batch>>``.
    """
    empty = F.array().cast("array<struct<k:bigint,size:bigint,batch:int>>")
    start = F.struct(
        F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("used"), F.lit(None).cast("bigint").alias("last"), empty.alias("out")
    )

    def step(acc, x):
        over = acc.used + x.size > limit
        if adjacent:
            over = over | (x.k != acc.last + 1)
        close = acc.last.isNotNull() & over
        batch = acc.batch + F.when(close | acc.last.isNull(), F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            batch.alias("batch"),
            (F.when(close, F.lit(0)).otherwise(acc.used) + x.size).alias("used"),
            x.k.alias("last"),
            F.concat(acc.out, F.array(F.struct(x.k.alias("k"), x.size.alias("size"), batch.alias("batch")))).alias("out"),
        )

    return F.aggregate(items, start, step, lambda acc: acc.out)


def page_batches(sentences: DataFrame, limit: int = 12_000) -> DataFrame:
    """Consecutive pages of a paper packed into translation batches by text length."""
    pages = sentences.groupBy("paper_id", "page").agg(F.sum(F.length("text")).alias("size"))
    packed = (
        pages.groupBy("paper_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("page").cast("bigint").alias("k"), "size"))).alias("p"))
        .select("paper_id", F.explode(pack(F.col("p"), limit, True)).alias("x"))
    )
    return packed.select("paper_id", F.col("x.k").alias("page"), F.col("x.size").alias("chars"), "x.batch")


def wrap_around(pages: DataFrame, focus: Column) -> DataFrame:
    """Page order of a paper starting at the page in view, then from the front (column ``turn``)."""
    w = Window.partitionBy("paper_id").orderBy(F.col("page") < focus, "page")
    return pages.withColumn("turn", F.row_number().over(w))


def cluster_starts(points: Column) -> Column:
    """Cluster ordered ``ARRAY<STRUCT<y,fs>>``; a point far from the start of the open cluster opens one."""
    none = F.array().cast("array<double>")

    def step(acc, p):
        far = let(
            F.get(acc, F.size(acc) - 1), lambda last: last.isNull() | (p.y - last > F.greatest(F.lit(2.0), p.fs * 0.45))
        )
        return F.when(far, F.concat(acc, F.array(p.y))).otherwise(acc)

    return F.aggregate(points, none, step)


def key_sentences(sentences: DataFrame, categories: list[str], every: int = 9) -> DataFrame:
    """Baseline picks: every k-th sentence (offset 3), categories in turn."""
    names = F.array(*[F.lit(c) for c in categories])
    # The position within the paper is its reading order; labels carry ids too.
    return (
        sentences.where((F.col("ord") - 1) % every == 3)
        .withColumn("i", ((F.col("ord") - 4) / every).cast("bigint"))
        .select("paper_id", "sid", F.element_at(names, (F.col("i") % len(categories) + 1).cast("int")).alias("category"))
    )
