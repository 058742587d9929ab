"""Glossary terms against text: first occurrences and per-batch relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expr import let


def variants(term: Column) -> Column:
    """Spellings of a term: split on commas and parentheses, two characters or more, longest first."""
    parts = F.filter(F.transform(F.split(term, r",\s*|\s*\(|\)"), lambda x: F.trim(x)), lambda v: F.length(v) >= 2)
    by_length = F.sort_array(F.transform(parts, lambda v, i: F.struct((-F.length(v)).alias("k"), i.alias("i"), v.alias("v"))))
    return F.transform(by_length, lambda x: x.v)


def _spellings(terms: DataFrame) -> DataFrame:
    keys = [c for c in terms.columns if c != "term"]
    return terms.select(*keys, "term", F.explode(variants(F.col("term"))).alias("variant")).withColumn(
        "variant", F.lower("variant")
    )


def _pairs(text: Column | str) -> Column:
    """Distinct pairs of neighbouring characters."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return let(
        chars,
        lambda c: F.array_distinct(
            F.zip_with(
                F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
                F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
                lambda a, b: F.concat(a, b),
            )
        ),
    )


def first_occurrences(terms: DataFrame, sentences: DataFrame) -> DataFrame:
    """First sentence (reading order, labels skipped) of each paper that holds each term as whole words.

    ``terms`` (paper_id, term) is each paper's own glossary; without paper_id one glossary
    serves all papers. Sentences meet terms on the variant's first run of letters, or, if it has none (other
    scripts, numbers), on its first two characters; only sentences that hold these are
    checked, and the winner per (paper, term) is a partial aggregate.
    """
    word = F.regexp_extract("variant", "[a-z]+", 0)
    spell = _spellings(terms).withColumn("token", F.when(word != "", word).otherwise(F.substring("variant", 1, 2)))
    words = F.regexp_extract_all("low", F.lit("[a-z]+"), F.lit(0))
    # All pairs of neighbours without a letter; they overlap, so they are looked ahead for.
    others = F.regexp_extract_all("low", F.lit("(?s)(?=([^a-z]{2}))"), F.lit(1))
    tokens = (
        sentences.where("kind <> 'label'")
        .withColumn("low", F.lower("text"))
        .select("paper_id", "sid", "ord", "low", F.explode(F.array_distinct(F.concat(words, others))).alias("token"))
    )
    padded = F.concat(F.lit(" "), "low", F.lit(" "))
    whole = F.concat(F.lit(r"[^a-z]\Q"), "variant", F.lit(r"\E[^a-z]"))
    return (
        tokens.join(spell, [c for c in ("paper_id", "token") if c in spell.columns])
        .where(((F.col("token") == F.col("variant")) & F.col("token").rlike("[a-z]")) | F.rlike(padded, whole))
        .groupBy("paper_id", "term")
        .agg(F.min_by("sid", "ord").alias("sid"))
    )


def meetings(terms: DataFrame, batches: DataFrame, *key: str) -> DataFrame:
    """Rows (key..., term, variant) of the batches that hold the rarest character pair of a spelling."""
    owner = [c for c in key if c in terms.columns]
    spell = _spellings(terms).distinct()
    grams = batches.select(*key, F.explode(_pairs(F.lower("text"))).alias("gram"))
    held = grams.groupBy(*owner, "gram").agg(F.count("*").alias("n"))
    parts = spell.withColumn("grams", _pairs("variant")).select(
        *owner, "term", "variant", F.size("grams").alias("need"), F.explode("grams").alias("gram")
    )
    rarest = (
        parts.join(held, [*owner, "gram"])
        .groupBy(*owner, "term", "variant", "need")
        .agg(F.min(F.struct("n", "gram")).getField("gram").alias("gram"), F.count("*").alias("found"))
        .where("found = need")
        .drop("need", "found")
    )
    return grams.join(rarest, [*owner, "gram"]).select(*key, "term", "variant")


def glossaries(terms: DataFrame, *owner: str) -> DataFrame:
    """(owner..., spellings): an owner's glossary as one array of (term, variant)."""
    pair = F.struct("term", "variant")
    return _spellings(terms).groupBy(*owner).agg(F.collect_set(pair).alias("spellings"))


def relevant_terms(terms: DataFrame, batches: DataFrame, *key: str) -> DataFrame:
    """Terms with a spelling contained in the batch text: rows (key..., term).

    ``terms`` holds a term and those of the ``key`` columns that own it (a paper's own
    glossary); with none of them, one glossary serves all batches. ``key`` names a batch and
    is not null; a batch without text holds nothing.

    An owner's glossary is one array (``terms`` may come as ``glossaries``) and each of its batches
    is read for it in place: rows are made of what is found, not of what is looked for.

    A shared glossary may be large. A spelling contained in a text brings all its character
    pairs with it, so it meets only the batches that hold the rarest of them; a spelling with
    a pair that none of these holds goes, and the text itself is read for the
    batches that remain. The rarest pair bounds the candidates, however common the others are.
    """
    low = batches.select(*key, F.lower("text").alias("low"))
    owner = [c for c in key if c in terms.columns]
    if not owner:
        near = meetings(terms, batches, *key).join(low, list(key))
        return near.where(F.contains("low", "variant")).select(*key, "term").distinct()
    own = terms if "spellings" in terms.columns else glossaries(terms, *owner)
    found = F.transform(F.filter("spellings", lambda s: F.contains("low", s.variant)), lambda s: s.term)
    j = low.join(own.select(*owner, "spellings"), owner)
    return j.select(*key, F.explode_outer(F.array_distinct(found)).alias("term")).where("term is not null").distinct()
