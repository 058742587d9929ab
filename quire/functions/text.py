"""Scalar text functions: counts, normal forms, names, references, summaries, quota time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.expr import let

CJK_WORD = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
# Any character of a Chinese, Japanese or Korean script.
HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CJK_GAP = r"([\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]) (?=[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}])"

# Full-width forms U+FF01..U+FF5E are ASCII 0x21..0x7E shifted; U+3000 is the wide blank.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "
# Latin ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}


def word_count(text: Column) -> Column:
    """Latin tokens plus CJK characters / 1.6."""
    cjk = F.regexp_count(text, F.lit(CJK_WORD))
    latin = F.size(F.filter(F.split(F.regexp_replace(text, CJK_WORD, " "), r"\s+"), lambda w: w != ""))
    return latin + cjk / F.lit(1.6)


def compat(text: Column) -> Column:
    """The part of Unicode compatibility folding that papers need: wide forms and ligatures."""

    def folded(t):
        out = F.translate(t, _WIDE, _NARROW)
        for lig, plain in LIGATURES.items():
            out = F.replace(out, F.lit(lig), F.lit(plain))
        # Plain ASCII has nothing to fold.
        return F.when(t.rlike(r"[^\x00-\x7f]"), out).otherwise(t)

    return let(text, folded)


def letters_only(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(compat(text)), r"[^\p{L}\p{N}]", "")


def title_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def journal_key(name: Column) -> Column:
    n = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"^the\s+", "")
    return F.trim(F.regexp_replace(n, r"[^a-z0-9]+", " "))


def issn_key(issn: Column) -> Column:
    d = F.upper(F.replace(issn, F.lit("-"), F.lit("")))
    return F.concat(F.substring(d, 1, 4), F.lit("-"), F.substr(d, F.lit(5)))


def doi_key(doi: Column) -> Column:
    return F.lower(F.regexp_replace(doi, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def find_doi(text: Column) -> Column:
    """First DOI in the text without trailing punctuation; NULL if there is none."""
    hit = F.regexp_extract(text, r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+[A-Za-z0-9])", 1)
    return F.when(hit != "", F.regexp_replace(hit, r"[.;,)]+$", ""))


def safe_file_name(s: Column) -> Column:
    name = F.trim(F.substring(F.regexp_replace(s, r'[\\/:*?"<>|]+', " "), 1, 80))
    return F.when(name == "", F.lit("paper")).otherwise(name)


def collapse_selection(s: Column) -> Column:
    """Collapse layout blanks, and drop the blank between two CJK characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), CJK_GAP, "$1"))


def conclusion(md: Column) -> Column:
    """The one-sentence conclusion of a one-page summary, as plain text."""
    section = F.regexp_extract(md, r"(?s)##\s*一句話結論[^\n]*\n+(.*?)(?:\n##|\z)", 1)
    has = md.rlike(r"##\s*一句話結論[^\n]*\n")
    plain = F.filter(F.split(md, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    block = F.when(has, section).otherwise(F.coalesce(F.get(plain, F.lit(0)), F.lit("")))
    block = F.regexp_replace(block, r"\[\[[^\]]*\]\]", "")
    block = F.regexp_replace(block, r"\[([^\]]*)\]\([^)]*\)", "$1")
    block = F.regexp_replace(block, r"[*_`>#|]", "")
    return F.trim(F.regexp_replace(block, r"\s+", " "))


def split_name(display: Column) -> Column:
    """``STRUCT<display,family,given>``; CJK names without a blank put the family name first."""
    d = F.trim(display)
    parts = F.split(d, r"\s+")
    n = F.size(parts)
    cjk = d.rlike(r"[\x{4e00}-\x{9fff}]") & ~F.contains(d, F.lit(" "))
    given = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), " ")
    return F.struct(
        d.alias("display"),
        F.when(cjk, F.substring(d, 1, 1)).otherwise(F.element_at(parts, -1)).alias("family"),
        F.when(cjk, F.substr(d, F.lit(2))).when(given != "", given).alias("given"),
    )


def abstract_from_index(index: Column, limit: int = 1500) -> Column:
    """Text of an inverted index ``MAP<word, ARRAY<position>>``; the later map entry wins a position."""
    entries = F.transform(
        F.map_entries(index),
        lambda e, i: F.transform(e.value, lambda p: F.struct(p.alias("p"), (-i).alias("late"), e.key.alias("w"))),
    )
    words = let(
        F.sort_array(F.flatten(entries)),
        lambda placed: F.transform(placed, lambda x, i: F.when((i == 0) | (F.get(placed, i - 1).p != x.p), x.w)),
    )
    text = F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " ")
    return let(
        text, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)
    )


def printed_page(page_index: Column, *offsets: Column) -> Column:
    """Printed page of a zero-based page index under the first known offset; NULL unless positive."""
    n = page_index + F.coalesce(*offsets)
    return F.when(n > 0, n.cast("string"))


def initials(given: Column) -> Column:
    parts = F.filter(F.split(given, r"[\s-]+"), lambda g: g != "")
    return F.array_join(F.transform(parts, lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit("."))), " ")


def author_short(authors: Column, title: Column) -> Column:
    first = F.get(authors, F.lit(0)).family
    return (
        F.when(F.size(authors) == 0, F.array_join(F.slice(F.split(title, r"\s+"), 1, 3), " "))
        .when(F.size(authors) == 1, first)
        .when(F.size(authors) == 2, F.concat(first, F.lit(" & "), F.get(authors, F.lit(1)).family))
        .otherwise(F.concat(first, F.lit(" et al.")))
    )


def year_text(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("n.d."))


def in_text(authors: Column, title: Column, year: Column, page: Column) -> Column:
    where = F.when(page.isNotNull() & (page != ""), F.concat(F.lit(", p. "), page)).otherwise(F.lit(""))
    return F.concat(F.lit("("), author_short(authors, title), F.lit(", "), year_text(year), where, F.lit(")"))


def quote_with_citation(text: Column, citation: Column) -> Column:
    return F.concat(F.lit("“"), F.trim(text), F.lit("” "), citation)


def reference(p: dict[str, Column]) -> Column:
    """Full reference. ``p`` holds columns authors, year, title, journal, volume, issue, first_page, last_page, doi."""
    names = F.transform(
        p["authors"],
        lambda a: F.when(
            a.given.isNotNull() & (a.given != ""), F.concat(a.family, F.lit(", "), initials(a.given))
        ).otherwise(a.family),
    )
    n = F.size(p["authors"])
    last = F.get(names, n - 1)
    listed = (
        F.when(n == 0, F.lit(""))
        .when(n == 1, last)
        .when(n <= 20, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), last))
    )

    def part(value: Column, text: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), text).otherwise(F.lit(""))

    pages = F.concat(F.lit(", "), p["first_page"], part(p["last_page"], F.concat(F.lit("–"), p["last_page"])))
    venue = F.concat(
        F.lit(" *"), p["journal"], F.lit("*"),
        part(p["volume"], F.concat(F.lit(", *"), p["volume"], F.lit("*"))),
        part(p["issue"], F.concat(F.lit("("), p["issue"], F.lit(")"))),
        part(p["first_page"], pages),
        F.lit("."),
    )
    return F.concat(
        listed, F.lit(" ("), year_text(p["year"]), F.lit("). "), p["title"], F.lit("."),
        part(p["journal"], venue),
        part(p["doi"], F.concat(F.lit(" https://doi.org/"), p["doi"])),
    )


def author_line(authors: Column, year: Column, journal: Column) -> Column:
    """Up to three families (then ``et al.``), year and journal with middle dots between."""
    families = F.array_join(F.transform(F.slice(authors, 1, 3), lambda a: a.family), ", ")
    names = F.concat(families, F.when(F.size(authors) > 3, F.lit(" et al.")).otherwise(F.lit("")))
    parts = F.array(names, year.cast("string"), journal)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " · ")


def next_quota_reset(now_ms: Column, zone: str = "America/Los_Angeles") -> Column:
    """Five minutes past the next local midnight, in epoch ms, under the offset in force now."""
    utc = F.timestamp_millis(now_ms)
    wall = F.unix_millis(F.from_utc_timestamp(utc, zone))
    wall = F.floor(wall / 1000) * 1000
    day = 86_400_000
    return ((F.floor(wall / day) + 1) * day + 300_000 + (now_ms - wall)).cast("bigint")
