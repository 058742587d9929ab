"""Citation graph: neighbours, related-paper ranking, trending works, library flags.

Edges are ``(src cites dst)``. A much-cited work may hold a large share of all edges,
so lists per work are taken with row_number filters (which Spark limits before the
shuffle) and source sets are bit masks, never collected lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import let
from quire.operators.joins import left_join
from quire.operators.linkage import match_journals

# Weight of each candidate source, in the order of the labels below.
SOURCES = ("cites", "related", "ref", "topic", "search")
WEIGHTS = {"cites": 3.0, "related": 2.0, "ref": 1.5, "topic": 2.5, "search": 1.5}
LABELS = {
    "cites": "引用了本篇",
    "ref": "本篇的參考文獻",
    "related": "OpenAlex 相關作品",
    "search": "與本篇關鍵詞相符",
    "topic": "符合你的研究主題",
}
ARTICLE_TYPES = ("article", "review", "book-chapter", "preprint")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark applies the limit before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def neighbours(edges: DataFrame, works: DataFrame, max_refs: int = 150, max_citing: int = 25) -> DataFrame:
    """(seed, direction, rank, work): references by first author, citing works by citation count.

    ``works`` (id, cited_by, family): the first author's family name, null sorts as an empty
    one. Names are compared by the root collation, accents and case last; equal ones keep the
    order of ids, by which the list of references is also cut.
    """
    meta = works.select(F.col("id").alias("work"), "cited_by", F.coalesce("family", F.lit("")).alias("family"))
    refs = top_k(edges.select(F.col("src").alias("seed"), F.col("dst").alias("work")), ["seed"], [F.col("work")], max_refs)
    refs = refs.drop("rank").join(meta, "work")
    by_name = Window.partitionBy("seed").orderBy(F.collate("family", "UNICODE"), "work")
    refs = refs.withColumn("rank", F.row_number().over(by_name))
    citing = edges.select(F.col("dst").alias("seed"), F.col("src").alias("work")).join(meta, "work")
    citing = top_k(citing, ["seed"], [F.col("cited_by").desc(), F.col("work")], max_citing)
    keep = ["seed", "work", "rank", "cited_by"]
    return refs.select(*keep, F.lit("reference").alias("direction")).unionByName(
        citing.select(*keep, F.lit("cited_by").alias("direction"))
    )


def flag_owned(works: DataFrame, library: DataFrame) -> DataFrame:
    """Work key, and whether the library holds the work's DOI (live rows only)."""
    dois = library.where("doi is not null").select(F.lower("doi").alias("doi_key")).distinct().withColumn("in_library", F.lit(True))
    return (
        left_join(works.withColumn("doi_key", F.lower("doi")), dois, ["doi_key"], ["id"])
        .select(
            "id",
            F.coalesce(F.col("id").cast("string"), "doi", "title").alias("work_key"),
            F.coalesce("in_library", F.lit(False)).alias("in_library"),
        )
    )


def not_owned(works: DataFrame, owned: DataFrame) -> DataFrame:
    o = owned.where("doi is not null").select(F.lower("doi").alias("_o")).distinct()
    return works.join(o, F.lower(works.doi) == F.col("_o"), "left_anti")


def with_tier(works: DataFrame, journals: DataFrame, only_listed: bool) -> DataFrame:
    """``works`` with the ``tier`` of the listed journal they match by ISSN or name; unlisted ones go, or have none."""
    none = F.lit(None).cast("array<string>")
    w = works if "issn" in works.columns else works.withColumn("issn", none)
    j = journals if "issn" in journals.columns else journals.withColumn("issn", none)
    tiers = match_journals(w.select("id", "journal", "issn"), j).select("id", "tier")
    return works.join(tiers.where("tier is not null"), "id", "inner" if only_listed else "left")


def trending(
    works: DataFrame, journals: DataFrame, owned: DataFrame, since: int, types: tuple[str, ...] = ARTICLE_TYPES, k: int = 15, only_listed: bool = True
) -> DataFrame:
    """Most cited recent articles (of listed journals, unless told otherwise) the library does not hold; a global top-k."""
    pool = works.where((F.col("yr") >= since) & F.col("wtype").isin(*types))
    pool = with_tier(not_owned(pool, owned), journals, only_listed)
    return pool.orderBy(F.desc("cited_by"), "id").limit(k).select(
        "id", "cited_by", "tier", F.concat(F.lit("近三年，被引用 "), F.col("cited_by").cast("string"), F.lit(" 次")).alias("reason")
    )


def max_normalised(score: Column, keys: list[str], top: int = 80) -> Column:
    """``round(score / max * top)`` with the maximum of the key at least 1."""
    best = F.greatest(F.lit(1.0), F.max(score).over(Window.partitionBy(*keys)))
    return F.floor(score / best * top + 0.5)


def source_mask(source: Column) -> Column:
    m = F.lit(0)
    for i, s in enumerate(SOURCES):
        m = F.when(source == s, F.lit(1 << i)).otherwise(m)
    return m


def _has(mask: Column, source: str) -> Column:
    return mask.bitwiseAND(1 << SOURCES.index(source)) != 0


def reason(mask: Column, joiner: str = "、") -> Column:
    return F.concat_ws(joiner, *[F.when(_has(mask, s), F.lit(LABELS[s])) for s in SOURCES])


def candidates(edges: DataFrame, works: DataFrame, given: DataFrame, max_citing: int = 30, max_refs: int = 50) -> DataFrame:
    """(seed, work, source) from the graph plus ``given`` rows of the same shape (related, topic, search lists)."""
    citing = edges.select(F.col("dst").alias("seed"), F.col("src").alias("work")).join(
        works.select(F.col("id").alias("work"), "cited_by"), "work"
    )
    citing = top_k(citing, ["seed"], [F.col("cited_by").desc(), F.col("work")], max_citing)
    refs = top_k(edges.select(F.col("src").alias("seed"), F.col("dst").alias("work")), ["seed"], [F.col("work")], max_refs)
    return (
        citing.select("seed", "work", F.lit("cites").alias("source"))
        .unionByName(refs.select("seed", "work", F.lit("ref").alias("source")))
        .unionByName(given)
    )


def rank_related(
    cands: DataFrame, works: DataFrame, journals: DataFrame, owned: DataFrame, year: int,
    types: tuple[str, ...] = ARTICLE_TYPES, rescored: DataFrame | None = None, pool: int = 30, k: int = 20, only_listed: bool = True,
) -> DataFrame:
    """Related works per seed: score the source set, citations, tier and age; keep a pool, normalise, top ``k``.

    ``rescored`` (seed, work, score[, reason]) replaces pool scores and reasons where present,
    scores clamped to 0-100. Works outside the journal list go, or stay without a tier's bonus.
    """
    sets = cands.where("seed <> work").groupBy("seed", "work").agg(F.bit_or(source_mask(F.col("source"))).alias("mask"))
    meta = not_owned(works.where(F.col("wtype").isNull() | F.col("wtype").isin(*types)), owned)
    meta = with_tier(meta, journals, only_listed)
    extra = (
        F.log10(F.col("cited_by") + 1.0)
        + F.when(F.col("tier") == 1, 2.0).when(F.col("tier") == 2, 1.5).when(F.col("tier").isNotNull(), 0.5).otherwise(0.0)
        + F.when(F.col("yr").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.lit(year) - F.col("yr")) / 25.0))
    )
    meta = meta.select(F.col("id").alias("work"), extra.alias("extra"), "tier")
    pre = sum((F.when(_has(F.col("mask"), s), F.lit(w)).otherwise(F.lit(0.0)) for s, w in WEIGHTS.items()), F.col("extra"))
    scored = sets.join(meta, "work").withColumn("pre", F.round(pre, 9))
    best = top_k(scored, ["seed"], [F.col("pre").desc(), F.col("work")], pool, "_r")
    best = best.withColumn("score", max_normalised(F.col("pre"), ["seed"]))
    best = best.withColumn("reason", reason(F.col("mask")))
    if rescored is not None:
        said = F.col("reason") if "reason" in rescored.columns else F.lit(None).cast("string")
        r = rescored.select("seed", "work", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("score") + 0.5))).alias("_new"), said.alias("_said"))
        best = best.join(r, ["seed", "work"], "left").withColumn("score", F.coalesce("_new", "score")).withColumn("reason", F.coalesce("_said", "reason"))
    return top_k(best, ["seed"], [F.col("score").desc(), F.col("_r")], k).select(
        "seed", "rank", "work", "score", "tier", "reason"
    )


def tree_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """Depth and sortable path of every node (k, name, parent) that hangs on a root, by a recursive query.

    A tree deeper than ``max_depth`` levels, as a cycle that a root leads into makes it, is an
    error; nodes that no root leads to are left out. The session's
    ``spark.sql.cteRecursionRowLimit`` bounds the nodes.
    """
    too_deep = f"raise_error('tree deeper than {max_depth} levels, or a cycle')"
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE walk(k, name, depth, path) MAX RECURSION LEVEL {max_depth + 2} AS (
              SELECT k, name, 0, k FROM {{nodes}} WHERE parent IS NULL
              UNION ALL
              SELECT t.k, t.name, CASE WHEN walk.depth < {max_depth} THEN walk.depth + 1 ELSE {too_deep} END, concat(walk.path, '/', t.k)
              FROM {{nodes}} t JOIN walk ON t.parent = walk.k)
            SELECT * FROM walk""",
        nodes=nodes,
    )
