"""Imports: content registry, identity resolution, manager items, job stages, metadata overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import left_join

# Job stages in order of progress.
STAGES = ("queued", "parsing", "meta", "overview", "translating", "related", "onepager", "paused", "done", "error")


def file_registry(files: DataFrame) -> DataFrame:
    """Map every file to the first file with the same content: (id, hash, size, first_id, copies).

    The first id is an aggregate, so a content that makes up a third of all files is one
    summary row and never a sorted group.
    """
    firsts = files.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return files.join(firsts, "hash")


def resolve_imports(batch: DataFrame, library: DataFrame) -> DataFrame:
    """Action per imported file: ``existing`` (same content), ``merge`` (DOI of a file-less entry) or ``insert``.

    ``batch`` (id, hash, doi); ``library`` (id, hash, doi, has_file, deleted).
    """
    lib = library.where("not deleted")
    by_hash = lib.where("hash is not null").groupBy("hash").agg(F.min("id").alias("same"))
    by_doi = lib.where("not has_file and doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.min("id").alias("waiting"))
    j = batch.withColumn("_doi", F.lower("doi"))
    j = left_join(left_join(j, by_hash, ["hash"], ["id"]), by_doi, ["_doi"], ["id"])
    return j.select(
        "id",
        F.when(F.col("same").isNotNull(), "existing").when(F.col("waiting").isNotNull(), "merge").otherwise("insert").alias("action"),
        F.coalesce("same", "waiting", "id").alias("paper_id"),
    )


def link_saved(saved: DataFrame, resolved: DataFrame) -> DataFrame:
    """Saved works get the paper id of the import with their DOI."""
    r = resolved.where("doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.min("paper_id").alias("_paper"))
    s = left_join(saved.withColumn("_doi", F.lower("doi")), r, ["_doi"], saved.columns)
    return s.withColumn("paper_id", F.coalesce("_paper", "paper_id")).drop("_doi", "_paper")


def new_dois(requested: DataFrame, library: DataFrame) -> DataFrame:
    """Requested DOIs (normalised) the library does not hold yet."""
    from quire.functions.text import doi_key

    asked = requested.select(doi_key(F.trim("doi")).alias("doi")).where("doi <> ''").distinct()
    return asked.join(library.where("not deleted").select(F.lower("doi").alias("doi")), "doi", "left_anti")


def manager_states(items: DataFrame, attachments: DataFrame, library: DataFrame) -> DataFrame:
    """Import state of reference-manager items.

    ``items`` (key, num_children, doi, failed); ``attachments`` (item_key, item_type,
    content_type, link_mode); ``library`` (manager_key, doi, deleted).
    """
    live = library.where("not deleted")
    have = live.where("manager_key is not null").select(F.col("manager_key").alias("key")).distinct()
    dois = live.where("doi is not null").select(F.lower("doi").alias("_doi")).distinct()
    pdf = attachments.where(
        (F.col("item_type") == "attachment")
        & (F.col("content_type") == "application/pdf")
        & F.col("link_mode").rlike("^imported_(file|url)$")
    )
    pdf = pdf.select(F.col("item_key").alias("key")).distinct()
    j = (
        items.withColumn("_doi", F.lower("doi"))
        .join(have.withColumn("_have", F.lit(True)), "key", "left")
        .join(pdf.withColumn("_pdf", F.lit(True)), "key", "left")
    )
    j = left_join(j, dois.withColumn("_dup", F.lit(True)), ["_doi"], ["key"])
    has_pdf = F.col("_pdf") & (F.col("num_children") > 0)
    state = (
        F.when(F.col("_have"), "exists")
        .when(F.col("failed"), "error")
        .when(has_pdf, "imported")
        .when(F.col("_dup"), "exists")
        .otherwise("no-pdf")
    )
    return j.select("key", state.alias("state"))


def latest_stage(job_log: DataFrame) -> DataFrame:
    """Current stage per paper from a log of stage changes (paper_id, stage, at, seq, paused_until)."""
    last = F.max_by(F.struct("stage", "at", "paused_until"), F.struct("at", "seq"))
    return job_log.groupBy("paper_id").agg(last.alias("j")).select(
        "paper_id", "j.stage", "j.at", F.when(F.col("j.stage") == "paused", F.col("j.paused_until")).alias("paused_until")
    )


def status(has_file: Column, stage: Column, paused_until: Column, now: Column) -> Column:
    """What the library shows for a paper."""
    return (
        F.when(~has_file, "needs file")
        .when(stage.isNull() | (stage == "done"), "")
        .when(stage == "error", "failed")
        .when((stage == "paused") & (paused_until > now), "paused")
        .when(stage.isin("translating", "parsing", "meta", "overview", "related"), stage)
        .otherwise("queued")
    )


def resumable(papers: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Papers with a file whose job is neither finished nor failed nor still pausing."""
    j = papers.where("has_file and not deleted").join(jobs, "id", "left")
    waiting = F.coalesce((F.col("stage") == "paused") & (F.col("paused_until") > now), F.lit(False))
    return j.where(~waiting & (F.col("stage").isNull() | ~F.col("stage").isin("done", "error")))


def overlay_metadata(base: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Found bibliographic fields over the stored ones; a known DOI is kept; ``identity_changed`` marks new records."""
    f = found.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = base.join(f, "id", "left")
    over = [
        (F.coalesce(c, f"_{c}") if c == "doi" else F.coalesce(f"_{c}", c)).alias(c) if c in columns else F.col(c)
        for c in base.columns
    ]
    return j.select(*over, F.coalesce("_hit", F.lit(False)).alias("identity_changed"))


def invalidate(dependants: DataFrame, overlaid: DataFrame) -> DataFrame:
    """Derived rows of papers whose identity did not change."""
    changed = overlaid.where("identity_changed").select(F.col("id").alias("paper_id"))
    return dependants.join(changed, "paper_id", "left_anti")
