"""Highlights and comments: mirroring, hit tests, overlap segments, range repair, counts.

Tables: highlights ``(id, paper_id, sid, side, s, e, ...)`` with one row per range;
sentences ``(paper_id, sid, ord, page, block, kind, text)``; translations
``(paper_id, sid, t, mock)``. A popular paper may own a large share of all
highlights, so ranges are made distinct or counted before anything meets per sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expr import let
from quire.operators.joins import left_join

SENT = ["paper_id", "sid"]


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def mirrored(ranges: DataFrame, sentences: DataFrame, translations: DataFrame) -> DataFrame:
    """Both language texts of every highlight: its own words on the drawn side, whole sentences on the other.

    ``ranges`` has a row per range (id, pos, paper_id, sid, side, s, e); a highlight may run over
    several sentences and name one twice. Own parts are joined in order, source ones by a
    space; on the other side each sentence stands once, in the order of its first range.
    ``sid`` is the first range's. A highlight's ranges are bounded by its paper.
    """
    h = ranges.join(sentences.select(*SENT, "text"), SENT, "left").join(translations.select(*SENT, "t"), SENT, "left")
    own = F.when(F.col("side") == "src", F.col("text")).otherwise(F.col("t"))
    cut = F.coalesce(F.substr(own, (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")), F.lit(""))
    other = F.coalesce(F.when(F.col("side") == "src", F.col("t")).otherwise(F.col("text")), F.lit(""))
    parts = F.sort_array(F.collect_list(F.struct("pos", "sid", cut.alias("own"), other.alias("other"))))
    g = h.groupBy("id", "paper_id", "side").agg(parts.alias("p"))
    # A sentence's text is the same in all its ranges, so distinct pairs are distinct sentences.
    whole = F.array_distinct(F.transform("p", lambda x: F.struct(x.sid, x.other)))
    own_text = lambda sep: F.array_join(F.transform("p", lambda x: x.own), sep)
    other_text = lambda sep: F.array_join(F.transform(whole, lambda x: x.other), sep)
    src = F.col("side") == "src"
    return g.select(
        "id", "paper_id", F.get("p", F.lit(0)).sid.alias("sid"), "side",
        F.when(src, own_text(" ")).otherwise(other_text(" ")).alias("source_text"),
        F.when(src, other_text("")).otherwise(own_text("")).alias("target_text"),
    )


def locate(pieces: Column, offset: Column, home: Column) -> Column:
    """Page of an offset: the piece that holds it, else the first piece, else the home page."""
    at = F.get(F.filter(pieces, lambda p: (p.s <= offset) & (offset < p.e)), F.lit(0))
    return F.coalesce(at.p, F.get(pieces, F.lit(0)).p, home)


def topmost_hit(clicks: DataFrame, highlights: DataFrame) -> DataFrame:
    """Latest highlight under every click: inside its range on its own side, anywhere in the sentence on the other.

    Both sides are reduced to distinct places before they meet, so the join is bounded by
    the length of a sentence and not by how often it was highlighted or clicked.
    """
    ranges = highlights.groupBy(*SENT, "side", "s", "e").agg(F.max("id").alias("top"))
    places = clicks.select(*SENT, "side", "off").distinct()
    own = (
        places.join(ranges, [*SENT, "side"])
        .where("off >= s and off <= e")
        .groupBy(*SENT, "side", "off")
        .agg(F.max("top").alias("own_top"))
    )
    across = ranges.groupBy(*SENT, F.when(F.col("side") == "src", "tgt").otherwise("src").alias("side")).agg(
        F.max("top").alias("other_top")
    )
    hit = places.join(own, [*SENT, "side", "off"], "left").join(across, [*SENT, "side"], "left")
    hit = hit.select(*SENT, "side", "off", F.greatest("own_top", "other_top").alias("hit"))
    return clicks.join(hit, [*SENT, "side", "off"]).where("hit is not null")


def _cuts(highlights: DataFrame, display: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct clamped ranges with their count and last id, and the cut points per sentence."""
    h = highlights.join(display, SENT).select(
        *SENT, "id",
        F.greatest(F.lit(0), F.least("len", "s")).alias("ra"), F.greatest(F.lit(0), F.least("len", "e")).alias("rb"), "len",
    )
    ranges = h.groupBy(*SENT, "ra", "rb", "len").agg(F.max("id").alias("last_id"), F.count("*").alias("n"))
    points = (
        ranges.groupBy(*SENT)
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("ra", "rb", F.lit(0), "len"))))).alias("pts"))
    )
    return ranges, points


def overlap_segments(highlights: DataFrame, display: DataFrame) -> DataFrame:
    """Cut every sentence at its highlights' ends: (sentence, a, b, covering, last_id)."""
    ranges, points = _cuts(highlights, display)
    n = F.greatest(F.size("pts") - 1, F.lit(0))
    segs = points.select(
        *SENT, F.explode(F.zip_with(F.slice("pts", 1, n), F.slice("pts", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("g")
    ).select(*SENT, "g.a", "g.b")
    covered = (
        segs.join(ranges, SENT)
        .where("ra <= a and rb >= b")
        .groupBy(*SENT, "a", "b")
        .agg(F.sum("n").alias("covering"), F.max("last_id").alias("last_id"))
    )
    return segs.join(covered, [*SENT, "a", "b"], "left").select(
        *SENT, "a", "b", F.coalesce("covering", F.lit(0)).alias("covering"), F.coalesce("last_id", F.lit(-1)).alias("last_id")
    )


def shift_ranges(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Move target-side ranges after text was cut from the front of their sentence.

    ``ranges`` (id, pos, paper_id, sid, s, e), ``cuts`` (paper_id, sid, cut, len). A range
    left empty is dropped; when a touched highlight loses all its ranges, the first one
    is kept on the whole sentence.
    """
    j = ranges.join(cuts, SENT, "left")
    moved = j.select(
        "id", "pos", *SENT, F.col("cut").isNotNull().alias("touched"),
        F.when(F.col("cut").isNull(), F.col("s")).otherwise(F.greatest(F.lit(0), F.col("s") - F.col("cut"))).alias("s"),
        F.when(F.col("cut").isNull(), F.col("e")).otherwise(F.least("len", F.col("e") - F.col("cut"))).alias("e"),
        F.coalesce("len", "e").alias("len"),
    )
    item = F.struct("pos", *SENT, "s", "e", "len", "touched")
    per = moved.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("r"))  # the ranges of one selection

    def outcome(r):
        kept = F.filter(r, lambda x: ~x.touched | (x.e > x.s))
        whole = F.transform(F.slice(r, 1, 1), lambda x: x.withField("s", F.lit(0).cast("bigint")).withField("e", x.len))
        return F.when(F.size(kept) > 0, kept).otherwise(whole)

    out = per.where(F.exists("r", lambda x: x.touched)).select("id", F.explode(let(F.col("r"), outcome)).alias("x"))
    return out.select("id", "x.pos", "x.paper_id", "x.sid", "x.s", "x.e")


def coalesce_ranges(segments: DataFrame, selection: str) -> DataFrame:
    """Selection segments → one range per sentence, in order of first appearance (``first_pos``)."""
    return (
        segments.where("e > s")
        .groupBy(selection, *SENT)
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("pos").alias("first_pos"))
    )


def untranslated(sentences: DataFrame, translations: DataFrame) -> DataFrame:
    done = translations.where("t is not null and t <> ''").select(*SENT)
    return sentences.where("kind not in ('skip', 'label')").join(done, SENT, "left_anti")


def paragraph_context(selected: DataFrame, sentences: DataFrame, limit: int = 2500) -> DataFrame:
    """Text of every block that holds a selected sentence, in order, cut at ``limit`` characters."""
    blocks = selected.join(sentences.select(*SENT, "block"), SENT).select("paper_id", "block").distinct()
    return (
        sentences.join(blocks, ["paper_id", "block"], "left_semi")
        .groupBy("paper_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
        .select("paper_id", "block", F.substring(F.array_join(F.transform("x", lambda y: y.text), " "), 1, limit).alias("context"))
    )


def effective_categories(picked: DataFrame, legacy: DataFrame) -> DataFrame:
    """Whole-paper picks where a paper has any, else its legacy per-sentence categories."""
    have = picked.select("paper_id").distinct()
    return picked.unionByName(legacy.join(have, "paper_id", "left_anti"))


def quick_highlights(taps: DataFrame, highlights: DataFrame, sentences: DataFrame, translations: DataFrame) -> DataFrame:
    """Whole-sentence highlights for tapped sentences that have none yet; empty text is rejected."""
    fresh = taps.join(highlights.where("style = 'highlight'").select(*SENT), SENT, "left_anti")
    j = fresh.join(sentences.select(*SENT, "text", "page"), SENT).join(translations.select(*SENT, "t"), SENT, "left")
    text = F.when(F.col("side") == "src", F.col("text")).otherwise(F.coalesce("t", F.lit("")))
    return (
        j.withColumn("quote", text)
        .where("quote <> ''")
        .select("id", *SENT, "side", F.lit(0).alias("s"), F.length("quote").alias("e"), "quote", "page")
    )


def reparse_candidates(papers: DataFrame, highlights: DataFrame, current: int) -> DataFrame:
    """Papers parsed by an older engine that no live annotation depends on."""
    used = live(highlights).select("paper_id").distinct()
    old = papers.where(F.coalesce("engine_version", F.lit(1)) < current)
    return old.join(used, old.id == used.paper_id, "left_anti")


def reference_faults(refs: DataFrame, sentences: DataFrame, *by: str) -> DataFrame:
    """How many references (paper_id, sid, block, s, e) per ``by`` do not fit the corpus: rows (by..., n, unknown, bad_ranges, orphans).

    ``unknown`` names no sentence; ``bad_ranges`` is empty, negative, missing or runs beyond its
    sentence's text; ``orphans`` names a block its sentence does not belong to, or no sentence.
    Equal references are counted once before they meet the sentences, so a much-marked
    sentence brings no more rows than it has different marks.
    """
    cols = ["paper_id", "sid", "block", "s", "e"]
    marks = refs.groupBy(*cols, *by).agg(F.count("*").alias("_n"))
    own = sentences.select("paper_id", "sid", F.col("block").alias("_block"), F.coalesce(F.length("text"), F.lit(0)).alias("_len"))
    j = left_join(marks, own, ["paper_id", "sid"], [*cols, *by])
    known = F.col("_len").isNotNull()
    fits = F.coalesce((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("_len")), F.lit(False))
    count = lambda bad: F.sum(F.when(bad, F.col("_n")).otherwise(F.lit(0)))
    return j.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        count(~known).alias("unknown"),
        count(known & ~fits).alias("bad_ranges"),
        count(~known | ~F.equal_null("block", "_block")).alias("orphans"),
    )
