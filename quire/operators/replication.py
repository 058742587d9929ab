"""Change replication between devices, batch form.

Records are ``(user_id, tbl, id, data, deleted, updated_at, rev, ...)``. The server takes
a write that is at least as new as what it has; a device keeps its own on equal times.
Winners are struct maxima (partial aggregates before the shuffle), so a record or user
with very many versions never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordering import bucketed_row_number
from quire.operators.sequence import pack

KEY = ["user_id", "tbl", "id"]


def latest(changes: DataFrame, order: Sequence[str] = ("updated_at", "rev"), key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Last version of every record under ``order``."""
    rest = [c for c in changes.columns if c not in key]
    won = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_w"))
    return won.select(*key, "_w.*")


def push(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Server upsert: an older write never replaces a newer one, equal times go to the newcomer.

    Column ``applied`` marks records whose stored version now comes from the batch.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, ("updated_at", "_new", "rev")).withColumn("applied", F.col("_new") == 1).drop("_new")


def apply_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Device apply: ours stays when it is at least as new. ``source`` says which side won."""
    both = local.withColumn("_own", F.lit(1)).unionByName(remote.withColumn("_own", F.lit(0)))
    won = latest(both, ("updated_at", "_own", "rev"))
    return won.withColumn("source", F.when(F.col("_own") == 1, "local").otherwise("remote")).drop("_own")


def merge_prefer_left(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keyed union: every key of both sides, values from the left where it has them."""
    values = [c for c in left.columns if c not in key]
    r = right.select(*key, *[F.col(c).alias(f"_{c}") for c in values])
    return left.join(r, list(key), "full").select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in values])


def purge_deleted(children: DataFrame, papers: DataFrame) -> DataFrame:
    """Child rows of papers that are not tombstoned; ``papers`` (user_id, paper_id, deleted)."""
    dead = papers.where("deleted").select("user_id", "paper_id").distinct()
    return children.join(dead, ["user_id", "paper_id"], "left_anti")


def tombstone(records: DataFrame, doomed: DataFrame, now: Column) -> DataFrame:
    """Soft delete: rows named in ``doomed`` (same key) get a tombstone and a new time."""
    d = doomed.select(*KEY).distinct().withColumn("_dead", F.lit(True))
    j = records.join(d, KEY, "left")
    return j.withColumn("updated_at", F.when(F.col("_dead"), now).otherwise(F.col("updated_at"))).withColumn(
        "deleted", F.coalesce("_dead", "deleted")
    ).drop("_dead")


# -------------------------------------------------------- machine output ----


def merge_outputs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Merge all machine output of papers under epochs: translations, categories and finished pages.

    Both sides are rows (paper_id, epoch, layer, key, value, mock) with layer ``t``, ``c`` or
    ``p``; a null key only states an epoch. A lower remote epoch leaves ours alone, a higher
    one replaces everything, even by nothing; an equal one fills what is missing, and
    translations that are empty or mock. Result (paper_id, layer, key, value, origin,
    push_back); a paper is pushed back if the remote's epoch is lower or lacks real output of ours.
    """
    le = local.groupBy("paper_id").agg(F.max("epoch").alias("le"))
    re = remote.groupBy("paper_id").agg(F.max("epoch").alias("re"))
    ep = le.join(re, "paper_id", "full").select(
        "paper_id", F.coalesce("le", F.lit(0)).alias("le"), F.coalesce("re", F.lit(-1)).alias("re")
    )
    cell = ["paper_id", "layer", "key"]
    a = local.where("key is not null").select(*cell, F.col("value").alias("lv"), F.col("mock").alias("lmock"))
    b = remote.where("key is not null").select(*cell, F.col("value").alias("rv"))
    j = a.join(b, cell, "full").join(ep, "paper_id")
    poor = (F.col("layer") == "t") & ((F.col("lv") == "") | F.coalesce("lmock", F.lit(False)))
    kept = F.col("lv").isNotNull() & ~poor
    use_local = (F.col("le") > F.col("re")) | ((F.col("le") == F.col("re")) & (kept | F.col("rv").isNull()))
    merged = j.withColumn("value", F.when(use_local, F.col("lv")).otherwise(F.col("rv"))).withColumn(
        "origin", F.when(use_local, "local").otherwise("remote")
    )
    unknown = (F.col("le") > F.col("re")) | ((F.col("le") == F.col("re")) & kept & F.col("rv").isNull())
    flags = merged.groupBy("paper_id").agg(F.max(unknown).alias("push_back"))
    return merged.where("value is not null").select(*cell, "value", "origin").join(flags, "paper_id")


def merge_bundles(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``merge_outputs`` of translations alone: rows (paper_id, epoch, sid, t, mock) to (paper_id, sid, t, origin, push_back)."""
    as_layer = lambda d: d.select("paper_id", "epoch", F.lit("t").alias("layer"), F.col("sid").alias("key"), F.col("t").alias("value"), "mock")
    merged = merge_outputs(as_layer(local), as_layer(remote))
    return merged.select("paper_id", F.col("key").alias("sid"), F.col("value").alias("t"), "origin", "push_back")


def build_bundles(translations: DataFrame, picks: DataFrame, page_status: DataFrame, epochs: DataFrame) -> DataFrame:
    """One nested bundle per paper: (paper_id, epoch, t MAP, c MAP, pages ARRAY).

    Mock translations and their pages stay out; picks override legacy categories. A bundle
    is the output of one paper, so it is bounded by the paper's sentences.
    """
    t = translations.where("not coalesce(mock, false) and t is not null and t <> ''")
    texts = t.groupBy("paper_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sid", "t")))).alias("t"))
    legacy = translations.where("c is not null").select("paper_id", "sid", F.lit(0).alias("p"), "c")
    cats = legacy.unionByName(picks.select("paper_id", "sid", F.lit(1).alias("p"), "c"))
    cats = cats.groupBy("paper_id", "sid").agg(F.max_by("c", "p").alias("c"))
    cats = cats.groupBy("paper_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sid", "c")))).alias("c"))
    mock = translations.where("mock").select("paper_id", "page").distinct()
    done = page_status.where("done").select("paper_id", "page").join(mock, ["paper_id", "page"], "left_anti")
    pages = done.groupBy("paper_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    out = texts.join(cats, "paper_id", "full").join(pages, "paper_id", "full").join(epochs, "paper_id", "full")
    return out.select(
        "paper_id",
        F.coalesce("epoch", F.lit(0)).alias("epoch"),
        F.coalesce("t", F.create_map().cast("map<string,string>")).alias("t"),
        F.coalesce("c", F.create_map().cast("map<string,string>")).alias("c"),
        F.coalesce("pages", F.array().cast("array<bigint>")).alias("pages"),
    ).where("size(t) > 0 or size(c) > 0 or size(pages) > 0 or epoch <> 0")


def reset_epochs(bundles: DataFrame, reset: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Drop the machine output of reset papers and give them a new epoch: (rows, epochs)."""
    gone = reset.select("paper_id").distinct()
    epochs = bundles.groupBy("paper_id").agg(F.max("epoch").alias("epoch")).join(
        gone.withColumn("_r", F.lit(True)), "paper_id", "full"
    )
    epochs = epochs.select("paper_id", F.when(F.col("_r"), now).otherwise(F.col("epoch")).alias("epoch"))
    return bundles.join(gone, "paper_id", "left_anti"), epochs


def replace_rows(old: DataFrame, new: DataFrame, valid: DataFrame) -> DataFrame:
    """Replace-set write: all old rows of a paper give way to its new valid rows."""
    papers = new.select("paper_id").distinct()
    return old.join(papers, "paper_id", "left_anti").unionByName(
        new.join(valid.select("paper_id", "sid"), ["paper_id", "sid"], "left_semi").select(*old.columns)
    )


# -------------------------------------------------------- outbox and pull ----

HOUR = 3_600_000


def outbox(marks: DataFrame, per_batch: int = 40) -> DataFrame:
    """Pending records: one row per marked key with its last mark time, in numbered batches, oldest first."""
    keys = marks.groupBy("user_id", "tbl", "id").agg(F.max("at").alias("at"))
    keys = keys.withColumn("key", F.concat_ws(":", "tbl", F.col("id").cast("string")))
    ranked = bucketed_row_number(keys, ["user_id"], F.floor(F.col("at") / HOUR), ["at", "key"])
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / per_batch)).drop("rn")


def acknowledge(pending: DataFrame, sent: DataFrame) -> DataFrame:
    """Pending records after a push: a sent one leaves only if it was not marked again since."""
    return pending.join(sent.select("user_id", "tbl", "id", "at"), ["user_id", "tbl", "id", "at"], "left_anti")


def upload_parts(rows: DataFrame, max_chars: int = 900_000) -> DataFrame:
    """Greedy parts of each outbox batch by serialised size, order kept; an oversize row goes alone.

    ``rows`` (user_id, batch, seq, payload). A batch holds at most the outbox batch size.
    """
    per = rows.groupBy("user_id", "batch").agg(
        F.sort_array(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("k"), F.length("payload").cast("bigint").alias("size")))).alias("r")
    )
    out = per.select("user_id", "batch", F.explode(pack(F.col("r"), max_chars, False)).alias("x"))
    return out.select("user_id", "batch", F.col("x.k").alias("seq"), F.col("x.size").alias("chars"), F.col("x.batch").alias("part"))


def listing_pages(rows: DataFrame, keys: Sequence[str], cursor: str, size: int, width: int) -> DataFrame:
    """Number the pages a keyset listing would fetch; ``width`` is the cursor range of one bucket."""
    ranked = bucketed_row_number(rows, keys, F.floor(F.col(cursor) / width), [cursor])
    return ranked.withColumn("page", F.floor((F.col("rn") - 1) / size)).drop("rn")


def next_page(rows: DataFrame, cursor: str, after, size: int) -> DataFrame:
    """One keyset page: a filter the source can prune by, then a top-k."""
    return rows.where(F.col(cursor) > after).orderBy(cursor).limit(size)


def pull(local: DataFrame, remote: DataFrame, cursor: int, overlap: int = 15_000) -> tuple[DataFrame, DataFrame]:
    """Everything past ``cursor - overlap`` applied to ours; replays change nothing. Returns (state, new cursor)."""
    news = remote.where(F.col("rev") > max(0, cursor - overlap))
    state = apply_remote(local, news)
    return state, news.agg(F.greatest(F.lit(cursor), F.coalesce(F.max("rev"), F.lit(cursor))).alias("cursor"))


def stale(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Derived records whose local stamp is older than the remote one; both (user_id, id, at)."""
    lo = local.groupBy("user_id", "id").agg(F.max("at").alias("local_at"))
    re = remote.groupBy("user_id", "id").agg(F.max("at").alias("remote_at"))
    return lo.join(re, ["user_id", "id"]).where("local_at < remote_at")


def null_references(rows: DataFrame, column: str, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows that point at a tombstoned key point nowhere."""
    dead = tombstones.where("deleted").select(F.col(key).alias(column)).distinct().withColumn("_dead", F.lit(True))
    j = rows.join(dead, column, "left")
    return j.withColumn(column, F.when(~F.coalesce("_dead", F.lit(False)), F.col(column))).select(*rows.columns)


def visible(records: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of the signed-in tenants only."""
    return records.join(tenants.select("user_id").distinct(), "user_id", "left_semi")


def stamp_revisions(arrivals: DataFrame, order: str, width: int) -> DataFrame:
    """Monotone revision per tenant in arrival order."""
    return bucketed_row_number(arrivals, ["user_id"], F.floor(F.col(order) / width), [order], "revision")


def everything(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Keys of a full re-upload: every record, plus bundle, model and file of every live paper."""
    rows = records.select("tbl", F.col("id").cast("string").alias("id")).distinct()
    extra = papers.where("not deleted").select(
        F.explode(
            F.filter(
                F.array(F.lit("gen"), F.when(F.col("has_model"), F.lit("model")), F.when(F.col("has_file"), F.lit("file"))),
                lambda x: x.isNotNull(),
            )
        ).alias("tbl"),
        F.col("id").cast("string").alias("id"),
    )
    return rows.unionByName(extra).select(F.concat_ws(":", "tbl", "id").alias("key"), "tbl", "id")


def save_works(saved: DataFrame, again: DataFrame, now: Column) -> DataFrame:
    """Saving again keeps the first save time and the linked paper and lifts a tombstone."""
    a = again.groupBy("id").agg(F.max("meta").alias("_meta")).withColumn("_again", F.lit(True))
    j = saved.join(a, "id", "full")
    fresh = F.coalesce("_again", F.lit(False))
    return j.select(
        "id",
        F.coalesce("_meta", "meta").alias("meta"),
        F.coalesce("saved_at", now).alias("saved_at"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "paper_id",
        F.when(fresh, F.lit(False)).otherwise(F.col("deleted")).alias("deleted"),
    )


def reconcile(local: DataFrame, remote: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: live papers and files per side, pending changes, and what to do about a difference.

    ``local`` and ``remote`` (deleted, has_file); ``pending`` one row per waiting change.
    """
    def tally(df, side):
        return df.select(F.lit(side).alias("side"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("has_file", F.lit(False)).alias("has_file"))

    waiting = pending.select(F.lit("pending").alias("side"), F.lit(False).alias("deleted"), F.lit(False).alias("has_file"))
    is_ = lambda side: F.col("side") == side
    # One pass over the three inputs; every side is a conditional count.
    j = tally(local, "local").unionByName(tally(remote, "remote")).unionByName(waiting).agg(
        F.count_if(is_("local") & ~F.col("deleted")).alias("local_papers"), F.count_if(is_("local") & F.col("has_file")).alias("local_files"),
        F.count_if(is_("remote") & ~F.col("deleted")).alias("remote_papers"), F.count_if(is_("remote") & F.col("has_file")).alias("remote_files"),
        F.count_if(is_("pending")).alias("pending"),
    )
    advice = (
        F.when(F.col("local_papers") > F.col("remote_papers"), "upload all")
        .when(F.col("remote_papers") > F.col("local_papers"), "download all")
        .otherwise("in step")
    )
    return j.withColumn("advice", advice)
