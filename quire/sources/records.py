"""Sources: bibliographic JSON of three shapes, ``id<sep>text`` line records, lenient model JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expr import let
from quire.functions.text import abstract_from_index, doi_key, split_name

AUTHOR = "struct<display:string,family:string,given:string>"
# Schemas of the three JSON shapes, never inferred.
INDEX_SCHEMA = """id string, doi string, display_name string, publication_year int,
 authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>,
 primary_location struct<source:struct<display_name:string,issn:array<string>>,landing_page_url:string>,
 best_oa_location struct<pdf_url:string,landing_page_url:string>, open_access struct<oa_url:string>,
 cited_by_count int, biblio struct<volume:string,issue:string,first_page:string,last_page:string>,
 abstract_inverted_index map<string,array<int>>, type string, referenced_works array<string>, related_works array<string>"""
REGISTRY_SCHEMA = """DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>,
 `container-title` array<string>, ISSN array<string>, volume string, issue string, page string,
 issued struct<`date-parts`:array<array<int>>>, type string"""
MANAGER_SCHEMA = """key string, itemType string, title string, creators array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,
 date string, publicationTitle string, ISSN string, volume string, issue string, pages string, DOI string, abstractNote string, url string"""


def short_id(id_: Column) -> Column:
    return F.regexp_replace(id_, r"^https?://[^/]+/", "")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def from_index(w: DataFrame) -> DataFrame:
    """Citation-index works → common work rows."""
    src = F.col("primary_location.source")
    oa = F.col("open_access.oa_url")
    names = F.transform(
        F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>,raw_author_name:string>>")),
        lambda a: split_name(F.coalesce(a.author.display_name, a.raw_author_name, F.lit(""))),
    )
    return w.select(
        short_id(F.col("id")).alias("id"), doi_key(F.col("doi")).alias("doi"), F.coalesce("display_name", F.lit("(untitled)")).alias("title"),
        F.filter(names, lambda a: a.display != "").cast(f"array<{AUTHOR}>").alias("authors"), F.col("publication_year").alias("year"),
        src.display_name.alias("journal"), src.issn.alias("issn"), "biblio.volume", "biblio.issue", "biblio.first_page", "biblio.last_page",
        F.col("cited_by_count").alias("cited_by"), F.coalesce("best_oa_location.pdf_url", F.when(F.lower(oa).endswith(".pdf"), oa)).alias("oa_pdf"),
        F.coalesce(oa, "best_oa_location.landing_page_url").alias("oa_url"), F.coalesce("primary_location.landing_page_url", "doi").alias("landing"),
        abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"), "type",
    )


def from_registry(w: DataFrame) -> DataFrame:
    """DOI-registry items → common work rows."""
    pages = F.split("page", "[-–]")
    null = F.lit(None).cast("string")
    names = F.transform(
        F.coalesce("author", F.array().cast("array<struct<given:string,family:string,name:string>>")),
        lambda a: F.struct(
            F.coalesce(a["name"], F.concat_ws(" ", a.given, a.family)).alias("display"),
            F.coalesce(a.family, a["name"], F.lit("")).alias("family"), a.given.alias("given"),
        ),
    )
    return w.select(
        F.lower("DOI").alias("id"), F.lower("DOI").alias("doi"), F.coalesce(F.get("title", F.lit(0)), "DOI").alias("title"), names.cast(f"array<{AUTHOR}>").alias("authors"),
        F.get(F.get("issued.date-parts", F.lit(0)), F.lit(0)).alias("year"), F.get("container-title", F.lit(0)).alias("journal"),
        F.col("ISSN").alias("issn"), "volume", "issue", _filled(F.get(pages, F.lit(0))).alias("first_page"), _filled(F.get(pages, F.lit(1))).alias("last_page"),
        F.lit(None).cast("int").alias("cited_by"), null.alias("oa_pdf"), null.alias("oa_url"),
        F.concat(F.lit("https://doi.org/"), "DOI").alias("landing"), null.alias("abstract"), "type",
    )


def from_manager(w: DataFrame) -> DataFrame:
    """Reference-manager items → common work rows."""
    pages = F.transform(F.split("pages", "[-–]"), lambda x: F.trim(x))
    people = F.filter("creators", lambda c: c.creatorType.isin("author", "editor"))
    names = F.transform(
        people,
        lambda c: F.struct(
            F.concat_ws(" ", _filled(c.firstName), _filled(F.coalesce(c.lastName, c["name"]))).alias("display"),
            F.coalesce(c.lastName, c["name"], F.lit("")).alias("family"), c.firstName.alias("given"),
        ),
    )
    year = F.regexp_extract("date", r"\b((?:19|20)\d{2})\b", 1)
    null = F.lit(None).cast("string")
    return w.select(
        F.col("key").alias("id"), _filled(doi_key(F.col("DOI"))).alias("doi"), F.coalesce(_filled(F.col("title")), F.lit("（未命名）")).alias("title"),
        names.cast(f"array<{AUTHOR}>").alias("authors"), F.when(year != "", year.cast("int")).alias("year"), F.col("publicationTitle").alias("journal"),
        F.when(F.col("ISSN") != "", F.filter(F.split("ISSN", r"[,\s]+"), lambda x: x != "")).alias("issn"), "volume", "issue",
        _filled(F.get(pages, F.lit(0))).alias("first_page"), _filled(F.get(pages, F.lit(1))).alias("last_page"), F.lit(None).cast("int").alias("cited_by"),
        null.alias("oa_pdf"), null.alias("oa_url"), F.col("url").alias("landing"), F.col("abstractNote").alias("abstract"), null.alias("type"),
    )


SHAPES = {"index": (INDEX_SCHEMA, from_index), "registry": (REGISTRY_SCHEMA, from_registry), "manager": (MANAGER_SCHEMA, from_manager)}


def read_works(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Read JSON folders by shape (index, registry, manager) into one table with a ``shape`` column."""
    out = None
    for shape, path in paths.items():
        schema, fn = SHAPES[shape]
        w = fn(spark.read.schema(schema).json(path)).withColumn("shape", F.lit(shape))
        out = w if out is None else out.unionByName(w)
    return out


def parse_works(raw: DataFrame, column: str, shape: str) -> DataFrame:
    """The same from a column of JSON strings."""
    schema, fn = SHAPES[shape]
    return fn(raw.select(F.from_json(column, schema).alias("w")).select("w.*"))


# ------------------------------------------------------------ line records ----

LINE = r"^\s*(\d+\.\d+)\s*(?:\t|\s\|\s|｜|:\s)\s*(.+?)\s*$"


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., sid, text) of well-formed ``sid<sep>text`` lines in column ``value``."""
    hit = lines.where(F.col("value").rlike(LINE))
    return hit.select(*keep, F.regexp_extract("value", LINE, 1).alias("sid"), F.regexp_extract("value", LINE, 2).alias("text"))


def requested_only(parsed: DataFrame, requested: DataFrame, *key: str) -> DataFrame:
    """Lines whose id was asked for."""
    return parsed.join(requested.select(*key), list(key), "left_semi")


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return spark.readStream.text(path) if streaming else spark.read.text(path)


# --------------------------------------------------------------- model JSON ----


def lenient_json(text: Column) -> Column:
    """JSON text of an answer: without a code fence, or its outermost bracket span if that does not parse."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"```\s*\z", "")
    span = F.regexp_extract(body, r"(?s)([\[{].*[}\]])", 1)
    return let(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b).when(F.try_parse_json(span).isNotNull(), span))


GUIDE = """struct<titleZh:string,summary3:array<string>,keywords:array<struct<en:string,zh:string,def:string>>,
 glossary:array<struct<en:string,zh:string>>,highlights:array<struct<id:string,c:string>>>"""
QUIZ = "struct<questions:array<struct<q:string,options:array<string>,answer:int>>>"


def clean_guide(answers: DataFrame, categories: list[str]) -> DataFrame:
    """Usable parts of guide answers (paper_id, answer): summaries, bilingual terms, valid highlights."""
    g = answers.select("paper_id", F.from_json(lenient_json(F.col("answer")), GUIDE).alias("g"))
    both = lambda x: (x.en != "") & (x.zh != "")

    def kept(a, ok, empty):
        return F.coalesce(F.filter(a, ok), F.array().cast(empty))

    return g.select(
        "paper_id", F.coalesce("g.titleZh", F.lit("")).alias("title_zh"),
        F.slice(F.coalesce("g.summary3", F.array().cast("array<string>")), 1, 3).alias("summary"),
        kept(F.col("g.keywords"), both, "array<struct<en:string,zh:string,def:string>>").alias("keywords"),
        kept(F.col("g.glossary"), both, "array<struct<en:string,zh:string>>").alias("glossary"),
        kept(F.col("g.highlights"), lambda h: (h.id != "") & h.c.isin(*categories), "array<struct<id:string,c:string>>").alias("highlights"),
    )


def clean_quiz(answers: DataFrame) -> DataFrame:
    """Questions with two options or more and an answer among them."""
    q = answers.select("paper_id", F.from_json(lenient_json(F.col("answer")), QUIZ).alias("g"))
    ok = lambda x: (F.size(x.options) >= 2) & (x.answer >= 0) & (x.answer < F.size(x.options))
    return q.select("paper_id", F.filter("g.questions", ok).alias("questions"))
