"""Text-line and block operators: joining, classification, headers, page numbers, titles, hints, outline.

Block columns: paper_id, page, n (order on the page), text, n_lines, x0, y0, x1, y1, fs,
font, tbl, and the page's w and h. A page is a physical page, so work per (paper, page)
is bounded; everything per paper is an aggregate with few or no collected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import let
from quire.functions.text import find_doi, issn_key, word_count
from quire.operators.ordering import weighted_mode
from quire.operators.sequence import long_runs, soon

# Patterns for captions, boilerplate, terminators and letters.
TERMINAL = r"""[.?!。？！]["”’)\]]?\z"""
TERMINAL_OR_COLON = r"""[.?!:。？！：]["”’)\]]?\z"""
CAPTION = r"(?i)^(fig\.?|figure|table|tab\.|exhibit|chart|appendix|panel)\s*[\dA-Z]"
TABLE_CAPTION = r"(?i)^(table|tab\.)\s*[\dA-Z]"
BOILERPLATE = (
    r"(?i)(This content downloaded from|All use subject to|about\.jstor\.org/terms|JSTOR is a not-for-profit|"
    r"Your use of the JSTOR archive|Accessibility support|collaborating with JSTOR|Stable URL|"
    r"Linked references are available|Terms and Conditions of Use|Published by:|sci-hub|Downloaded from|"
    r"For personal use only|Copyright ©|All rights reserved|Terms of Use)"
)
LETTER = r"[A-Za-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
CJK = r"[\x{2e80}-\x{9fff}\x{ff00}-\x{ffef}]"
JOURNALISH = r"(?i)^(journal of|the journal|jstor|stable url|this content|downloaded|copyright|©|vol\.|volume|issn|american|academy of)"
NOT_A_TITLE = r"(?i)microsoft word|untitled|\.pdf$|^doi|sci-hub"
NOT_HEADING = r"(?i)^(keywords?|key words|jel|note|notes|source|\*|•|\(|\d+\s*$)"
CJK_SECTION = r"^[一二三四五六七八九十]+、"
JOIN = "\u0001"


def body_style(items: DataFrame) -> DataFrame:
    """Document-wide body font size and font: length-weighted modes, first seen wins ties; size 10 if none."""
    half = F.floor(F.col("fs") * 2 + 0.5) / 2
    size = weighted_mode(items, ["paper_id"], half, F.length("str"), F.col("ix"), "body_fs")
    font = weighted_mode(items, ["paper_id"], F.col("font"), F.length("str"), F.col("ix"), "body_font")
    return size.join(font, "paper_id").select(
        "paper_id", F.when(F.col("body_fs") == 0, F.lit(10.0)).otherwise(F.col("body_fs")).alias("body_fs"), "body_font"
    )


def join_lines(lines: Column) -> Column:
    """One text from ordered lines: line-end hyphens go, a blank joins lines unless a side is CJK."""
    t = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), JOIN)
    t = F.regexp_replace(t, rf"(?<=[A-Za-z])[-\x{{ad}}]{JOIN}(?=[a-z])", "")
    t = F.regexp_replace(t, rf"(?<={CJK}){JOIN}|{JOIN}(?={CJK})", "")
    return F.replace(t, F.lit(JOIN), F.lit(" "))


def block_texts(lines: DataFrame, *key: str) -> DataFrame:
    """Joined text per block from rows (key..., line_no, text); a block is a paragraph-sized group."""
    g = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    return g.select(*key, join_lines(F.transform("x", lambda y: y.text)).alias("text"))


def centered() -> Column:
    """The block is centred in its column and clearly narrower than it."""
    w, width = F.col("w"), F.col("x1") - F.col("x0")
    cx = (F.col("x0") + F.col("x1")) / 2
    left = F.when((width > 0.55 * w) | (cx < w / 2), F.lit(0.0)).otherwise(w / 2)
    right = F.when((width > 0.55 * w) | (cx >= w / 2), w).otherwise(w / 2)
    return (F.abs(cx - (left + right) / 2) < 0.04 * w) & (width < 0.7 * (right - left))


def classify(blocks: DataFrame) -> DataFrame:
    """Add ``kind`` (skip, caption, label, heading, para) to blocks joined with body_fs and body_font."""
    text = F.trim("text")
    b = blocks.withColumn("_t", text).withColumn("_words", word_count(text)).withColumn("_c", centered())
    t, words, n, fs = F.col("_t"), F.col("_words"), F.col("n_lines"), F.col("fs")
    letters = F.regexp_count(t, F.lit(LETTER))
    compact = F.length(F.regexp_replace(t, r"\s", ""))
    margin = (F.col("y1") < 0.085 * F.col("h")) | (F.col("y0") > 0.925 * F.col("h"))
    terminal = t.rlike(TERMINAL)
    w, width = F.col("w"), F.col("x1") - F.col("x0")
    column = F.when(width > 0.55 * w, w).otherwise(w / 2)
    short = (n <= 3) & (words <= 25) & ~terminal
    strong = (fs >= F.col("body_fs") * 1.12) | (F.col("font") != F.col("body_font")) | F.col("_c")
    line = short & (n == 1) & (words <= 12) & (width < 0.6 * column)
    kind = (
        F.when((letters < 2) | (letters < 0.4 * compact), "skip")
        .when(margin & (F.length(t) < 160) & (n <= 2), "skip")
        .when(t.rlike(BOILERPLATE) & (F.length(t) < 400), "skip")
        .when(t.rlike(CAPTION), "caption")
        .when(F.col("tbl"), F.when((words <= 5) & ~terminal, "label").otherwise("para"))
        .when(short & strong, "heading")
        .when(line, F.when(fs < F.col("body_fs") * 0.95, "label").otherwise("heading"))
        .when((fs < F.col("body_fs") * 0.92) & (words < 8) & ~terminal, "label")
        .when((n <= 2) & (words <= 6) & ~terminal, "label")
        .otherwise("para")
    )
    plain = ~F.col("tbl") & ~F.col("kind").isin("skip", "caption")
    return b.withColumn("kind", kind).withColumn("centered", plain & F.col("_c")).drop("_t", "_words", "_c")


# ------------------------------------------------ headers, page numbers ----


def header_key(text: Column) -> Column:
    """Letters and Han only, words of two characters or more: digits and scan noise do not matter."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z\x{4e00}-\x{9fff}]+", " "), " ")
    return F.array_join(F.filter(words, lambda x: F.length(x) > 1), " ")


def at_edge(body_fs: Column) -> Column:
    """Block near the top or bottom edge that is short and not larger than text."""
    edge = (F.col("y1") < 0.14 * F.col("h")) | (F.col("y0") > 0.86 * F.col("h"))
    return edge & (F.length("text") < 140) & (F.col("n_lines") <= 2) & (F.col("fs") <= body_fs * 1.25)


def running_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Mark repeated edge blocks (``running``). ``blocks`` need ``edge``; ``pages`` (paper_id, n_pages)."""
    b = blocks.withColumn("_key", F.when(F.col("edge"), header_key(F.col("text"))))
    seen = (
        b.where("length(_key) >= 4")
        .select("paper_id", "_key", "page")
        .distinct()
        .groupBy("paper_id", "_key")
        .agg(F.count("*").alias("_seen"))
    )
    repeated = seen.join(pages, "paper_id").where(F.col("_seen") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 0.25)))
    marked = repeated.select("paper_id", "_key", F.lit(True).alias("_hit"))
    return b.join(marked, ["paper_id", "_key"], "left").withColumn("running", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def page_candidates(text: Column) -> Column:
    """Numbers an edge block may be showing: range start, leading, trailing (in this order)."""
    t = F.trim(text)

    def number(pattern: str, years: bool) -> Column:
        hit = F.regexp_extract(t, pattern, 1)
        n = F.when(hit != "", hit.cast("int"))
        return F.when(n.between(1900, 2099) & (F.length(t) > 4), None).when(n > 0, n) if years else n

    found = F.array(
        number(r"(\d{1,4})\s*[-–]\s*\d{1,4}\s*\z", False),
        number(r"^\s*(\d{1,4})(?:\D|\z)", True),
        number(r"(?:^|\D)(\d{1,4})\s*\z", True),
    )
    usable = (F.length(t) <= 160) & ~t.rlike(BOILERPLATE)
    return F.when(usable, F.array_distinct(F.filter(found, lambda n: n.isNotNull()))).otherwise(F.array().cast("array<int>"))


def page_numbers(edge_blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Printed page numbers by plurality vote over the offset to the page index.

    ``edge_blocks`` (paper_id, page, n, text), ``pages`` (paper_id, n_pages). Returns
    (paper_id, page_offset, votes) and (paper_id, page, printed). Votes are counts per
    offset, so a paper with very many pages is never gathered.
    """
    c = edge_blocks.select("paper_id", "page", "n", F.posexplode(page_candidates(F.col("text"))).alias("i", "cand"))
    firsts = c.groupBy("paper_id", "page", "cand").agg(F.min(F.struct("n", "i")).alias("at"))
    votes = firsts.groupBy("paper_id", (F.col("cand") - F.col("page")).alias("off")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("paper_id").agg(F.max(F.struct("votes", "off")).alias("b")).join(pages, "paper_id")
    offsets = best.where(F.col("b.votes") >= F.when(F.col("n_pages") <= 2, 1).otherwise(2)).select(
        "paper_id", F.col("b.off").alias("page_offset"), F.col("b.votes").alias("votes")
    )
    voted = firsts.join(offsets, "paper_id", "left").groupBy("paper_id", "page").agg(
        F.max(F.when(F.col("cand") == F.col("page") + F.col("page_offset"), F.col("cand"))).alias("_v"), F.min_by("cand", "at").alias("_f")
    )
    return offsets, voted.select("paper_id", "page", F.coalesce("_v", "_f").alias("printed"))


# -------------------------------------------------------- title and hints ----


def guess_title(blocks: DataFrame) -> DataFrame:
    """Title per paper: the first large block on pages 0-1, replaced only by one larger by more than half a point."""
    words = F.size(F.split("text", r"\s+"))
    c = blocks.where((F.col("page") <= 1) & (F.col("kind") != "skip") & words.between(3, 40) & (F.col("fs") >= F.col("body_fs") * 1.15))
    per = c.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("page", "n", "fs", F.trim("text").alias("text")))).alias("c"))
    start = F.struct(F.lit(-1.0).alias("fs"), F.lit(None).cast("string").alias("text"))
    take = F.aggregate("c", start, lambda acc, b: F.when(acc.text.isNull() | (b.fs > acc.fs + 0.5), F.struct(b.fs.alias("fs"), b.text.alias("text"))).otherwise(acc))
    return per.select("paper_id", take.getField("text").alias("title"))


def citation_line(line: Column) -> Column:
    """``STRUCT<volume,year,first_page>`` of a line with a volume mark; NULL for other lines."""
    vol = r"(?i)\bVol(?:ume)?\.?\s*(\d{1,4})\b"

    def read(x):
        around = F.substring(line, F.greatest(F.lit(1), x.at - 60), F.least(x.at - 1, F.lit(60)) + 120)
        year = F.regexp_extract(around, r"\b(19[5-9]\d|20[0-4]\d)\b", 1)

        def pages(y):
            spans = F.regexp_extract_all(around, F.lit(r"\b(\d{1,5}\s*[–—-]\s*\d{1,5})\b(?!\s*\))"), F.lit(1))
            ab = F.transform(spans, lambda s: F.transform(F.split(s, r"\s*[–—-]\s*"), lambda z: z.cast("int")))
            ok = F.filter(ab, lambda p: (p[1] > p[0]) & (p[1] - p[0] < 250) & (y.isNull() | (p[0] != y)))
            return F.struct(x.v.alias("volume"), y.alias("year"), F.get(F.get(ok, F.lit(0)), F.lit(0)).alias("first_page"))

        return let(F.when(year != "", year.cast("int")), pages)

    hit = let(F.struct(F.regexp_extract(line, vol, 1).alias("v"), F.regexp_instr(line, F.lit(vol)).alias("at")), read)
    return F.when(line.rlike(vol), hit)


def citation_hints(lines: Column, heads: Column, pdf_title: Column, title: Column, doi: Column, first_printed: Column) -> Column:
    """Bibliographic hints from the first pages.

    ``lines`` ARRAY<STRING> of the first three pages; ``heads`` ARRAY<STRUCT<fs,i,text>> of
    headings and short paragraphs on the first two.
    """
    text = F.array_join(lines, "\n")
    labelled = F.regexp_extract_all(text, F.lit(r"ISSN[:\s]*((?:\d{4})-?(?:\d{3}[\dXx]))"), F.lit(1))
    marked = F.regexp_extract_all(text, F.lit(r"(?i)\b(\d{4}-\d{3}[\dXx])\s*\((?:print|online|electronic)\)"), F.lit(1))
    issn = F.array_distinct(F.transform(F.concat(labelled, marked), issn_key))

    def cite(found):
        full = F.filter(found, lambda c: c.year.isNotNull() | c.first_page.isNotNull())
        return F.coalesce(F.get(full, F.lit(0)), F.get(found, F.size(found) - 1))

    cited = let(F.filter(F.transform(lines, citation_line), lambda c: c.isNotNull()), cite)

    def wordy(t, lo, hi):
        n = F.size(F.split(t, r"\s+"))
        return (n >= lo) & (n <= hi)

    top = F.slice(
        F.sort_array(F.transform(F.filter(heads, lambda h: wordy(h.text, 3, 30) & ~h.text.rlike(JOURNALISH)), lambda h: F.struct((-h.fs).alias("k"), h.i.alias("i"), h.text.alias("text")))),
        1, 3,
    )
    own = F.when(wordy(pdf_title, 4, 10_000) & ~pdf_title.rlike(NOT_A_TITLE), pdf_title)
    titles = F.filter(F.concat(F.array(own, title), F.transform(top, lambda h: h.text)), lambda t: t.isNotNull() & (t != "") & ~t.rlike(JOURNALISH))
    return let(
        cited,
        lambda c: F.struct(
            F.coalesce(doi, find_doi(text)).alias("doi"),
            issn.alias("issn"),
            c.year.alias("year"),
            c.volume.alias("volume"),
            F.coalesce(c.first_page, first_printed).cast("string").alias("first_page"),
            F.slice(F.array_distinct(titles), 1, 4).alias("titles"),
        ),
    )


# ---------------------------------------------------------------- outline ----


def outline(sentences: DataFrame) -> DataFrame:
    """Section headings: (paper_id, sid, level, page).

    ``sentences`` (paper_id, sid, ord, page, kind, text, fs, body_fs, centered). Windows run
    over the sentences of one paper.
    """
    paper = Window.partitionBy("paper_id")
    text, fs, body = F.col("text"), F.col("fs"), F.col("body_fs")
    s = long_runs(sentences, F.col("kind").isin("heading", "label"))
    follows = ((F.col("kind") == "para") & (F.length("text") >= 60)) | (F.col("kind") == "caption")
    s = s.withColumn("_soon", soon(follows)).withColumn(
        "_first", F.min(F.when((F.col("kind") == "para") & (F.length("text") > 60), F.col("ord"))).over(paper)
    )
    prose = text.rlike(r"\.\s+\S") | ((F.length(text) > 60) & (fs < body * 1.15))
    ok = (
        (F.col("kind") == "heading") & ~F.col("in_run") & (F.col("_first").isNull() | (F.col("ord") >= F.col("_first")))
        & (fs >= body * 0.97) & (fs < body * 1.8) & (F.length(text) >= 2) & ~text.rlike(NOT_HEADING)
        & text.rlike(r"^[\p{Lu}\p{N}\p{IsHan}]") & ~prose & F.col("_soon")
    )
    big = (fs >= body * 1.25) | F.col("centered") | text.rlike(r"(?i)^(references?|bibliography|參考文獻)$")
    heads = s.where(ok).withColumn("level", F.when(big, 1).otherwise(2))
    numbered = F.max(text.rlike(CJK_SECTION)).over(paper)
    level = F.when(numbered & text.rlike(CJK_SECTION), 1).when(numbered & text.rlike(r"^\d+[.、．]"), 2).otherwise(F.col("level"))
    return heads.select("paper_id", "sid", level.alias("level"), "page")


# -------------------------------------------------------- sentence homes ----


def assign_homes(parts: DataFrame) -> DataFrame:
    """Sentence ids from the blocks a sentence runs through.

    ``parts`` (paper_id, sentence, block_no, page, chars, at): characters of a sentence in a
    block and where the first of them stands. Home is the block with most characters
    (first of equals); order is home block, then first position; ids are page.counter.
    """
    s = parts.groupBy("paper_id", "sentence").agg(
        # Most characters; of equals, the first place (which may be any ordered type).
        F.min_by(F.struct("block_no", "page"), F.struct(-F.col("chars"), F.col("at"))).alias("home"), F.min("at").alias("first_at")
    )
    w = Window.partitionBy("paper_id", "page").orderBy("block_no", "first_at")
    s = s.select("paper_id", "sentence", "home.block_no", F.col("home.page").alias("page"), "first_at")
    sid = F.concat_ws(".", (F.col("page") + 1).cast("string"), F.row_number().over(w).cast("string"))
    return s.select("paper_id", "sentence", "block_no", "page", sid.alias("sid"))
