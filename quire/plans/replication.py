"""Queries M1-M15, S10-S12, G7, G8, U4 over the change log and the machine-output bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.fixtures import Views
from quire.operators import replication as R
from quire.plans.registry import query
from quire.session import ensure_checkpoint_dir
from quire.sources import backup as B
from quire.sources import replace_sets

LOCAL, REMOTE = "origin = 'local'", "origin = 'remote'"
COLS = 'user_id, tbl, id, "data", updated_at, rev, deleted'
KEEP = ["user_id", "tbl", "id", "data", "updated_at", "rev", "deleted"]


@query(
    "M1_lww_upsert",
    f"""select {COLS}, origin='local' applied from changes_v qualify row_number() over (partition by user_id, tbl, id order by updated_at desc, origin='local' desc, rev desc)=1""",
)
def m1(v: Views):
    c = v.changes
    return R.push(c.where(REMOTE), c.where(LOCAL)).select(*KEEP, "applied")


@query(
    "M2_lww_apply_local_preference",
    f"""select {COLS}, origin source from changes_v qualify row_number() over (partition by user_id, tbl, id order by updated_at desc, origin='local' desc, rev desc)=1""",
)
def m2(v: Views):
    c = v.changes
    return R.apply_remote(c.where(LOCAL), c.where(REMOTE)).select(*KEEP, "source")


@query(
    "M3_tombstone_cascade",
    """with p as (select user_id, id paper_id, deleted from changes_v where tbl='signup' qualify row_number() over (partition by user_id, id order by updated_at desc, rev desc)=1)
       select user_id, tbl, id paper_id, rev from changes_v c where tbl<>'signup' and not exists (select 1 from p where deleted and p.user_id=c.user_id and p.paper_id=c.id)""",
)
def m3(v: Views):
    papers = R.latest(v.changes.where("tbl = 'signup'")).select("user_id", F.col("id").alias("paper_id"), "deleted")
    children = v.changes.where("tbl <> 'signup'").select("user_id", "tbl", F.col("id").alias("paper_id"), "rev")
    return R.purge_deleted(children, papers)


@query(
    "M4_union_merge_with_epoch",
    """with lo as (select * from bundles_v where origin='local'), re as (select * from bundles_v where origin='remote'),
       ep as (select coalesce(a.paper_id, b.paper_id) paper_id, coalesce(le, 0) le, coalesce(re, -1) re from (select paper_id, max(epoch) le from lo group by 1) a full join (select paper_id, max(epoch) re from re group by 1) b on a.paper_id=b.paper_id),
       j as (select coalesce(a.paper_id, b.paper_id) paper_id, coalesce(a.sid, b.sid) sid, a.t lt, b.t rt, a.t is not null and a.t<>'' and not a.mock kept from lo a full join re b on a.paper_id=b.paper_id and a.sid=b.sid),
       m as (select j.*, le, re, le>re or (le=re and (coalesce(kept,false) or rt is null)) own, le>re or (le=re and coalesce(kept,false) and rt is null) unk from j join ep using (paper_id)),
       r as (select paper_id, sid, case when own then lt else rt end t, case when own then 'local' else 'remote' end origin, bool_or(unk) over (partition by paper_id) push_back from m)
       select * from r where t is not null""",
)
def m4(v: Views):
    b = v.bundles
    return R.merge_bundles(b.where(LOCAL), b.where(REMOTE))


@query(
    "M4_merge_of_all_output",
    """with lo as (select * from outputs_v where origin='local'), re as (select * from outputs_v where origin='remote'),
       ep as (select coalesce(a.paper_id, b.paper_id) paper_id, coalesce(le, 0) le, coalesce(re, -1) re from (select paper_id, max(epoch) le from lo group by 1) a full join (select paper_id, max(epoch) re from re group by 1) b on a.paper_id=b.paper_id),
       ours as (select lo.*, le, re, "value" is not null and (layer<>'t' or ("value"<>'' and not mock)) kept from lo join ep using (paper_id)),
       theirs as (select re.*, le, ep.re from re join ep using (paper_id)),
       m as (select paper_id, layer, "key", "value", 'local' origin from ours where le>re or (le=re and (kept or not exists (select 1 from theirs t where t.paper_id=ours.paper_id and t.layer=ours.layer and t."key"=ours."key")))
             union all select paper_id, layer, "key", "value", 'remote' from theirs where re>le or (le=re and not exists (select 1 from ours o where kept and o.paper_id=theirs.paper_id and o.layer=theirs.layer and o."key"=theirs."key"))),
       f as (select paper_id from ep where le>re union select paper_id from ours where le=re and kept and not exists (select 1 from theirs t where t.paper_id=ours.paper_id and t.layer=ours.layer and t."key"=ours."key"))
       select m.*, paper_id in (select paper_id from f) push_back from m where "value" is not null""",
)
def m4_all(v: Views):
    return R.merge_outputs(v.outputs.where(LOCAL), v.outputs.where(REMOTE))


@query(
    "M5_epoch_reset",
    """select coalesce(e.paper_id, b.paper_id) paper_id, case when coalesce(e.paper_id, b.paper_id)%5=0 then 99 else e.epoch end epoch, coalesce(n, 0) n
       from (select paper_id, max(epoch) epoch from bundles_v group by 1) e left join (select paper_id, count(*) n from bundles_v where paper_id%5<>0 group by 1) b on b.paper_id=e.paper_id""",
)
def m5(v: Views):
    rows, epochs = R.reset_epochs(v.bundles, v.bundles.where("paper_id % 5 = 0"), F.lit(99).cast("bigint"))
    n = rows.groupBy("paper_id").agg(F.count("*").alias("n"))
    return epochs.join(n, "paper_id", "left").select("paper_id", "epoch", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "M6_outbox_capture",
    """with k as (select user_id, event_type tbl, k id, max(ms) "at" from ev_v group by all), o as (select *, tbl||':'||cast(id as varchar) as key from k)
       select user_id, tbl, id, key, "at", (row_number() over (partition by user_id order by "at", key)-1)//40 batch from o""",
)
def m6(v: Views):
    return R.outbox(v.ev.select("user_id", F.col("event_type").alias("tbl"), F.col("k").alias("id"), F.col("ms").alias("at")))


@query(
    "M6_outbox_acknowledge",
    """with p as (select user_id, event_type tbl, k id, max(ms) "at" from ev_v group by all), s as (select user_id, event_type tbl, k id, max(ms) "at" from ev_v where value < 60 group by all)
       select p.* from p where not exists (select 1 from s where s.user_id=p.user_id and s.tbl=p.tbl and s.id=p.id and s."at"=p."at")""",
)
def m6b(v: Views):
    marks = v.ev.select("user_id", F.col("event_type").alias("tbl"), F.col("k").alias("id"), F.col("ms").alias("at"), "value")
    key = ["user_id", "tbl", "id"]
    pending = marks.groupBy(*key).agg(F.max("at").alias("at"))
    sent = marks.where("value < 60").groupBy(*key).agg(F.max("at").alias("at"))
    return R.acknowledge(pending, sent).select(*key, "at")


@query(
    "M7_incremental_pull",
    f"""with n as (select * from changes_v where origin='local' or rev > 2500), c as (select max(rev) c from changes_v where origin='remote' and rev>2500)
       select {COLS}, origin source, greatest(4000, c) as "cursor" from n, c qualify row_number() over (partition by user_id, tbl, id order by updated_at desc, origin='local' desc, rev desc)=1""",
)
def m7(v: Views):
    c = v.changes
    state, cursor = R.pull(c.where(LOCAL), c.where(REMOTE), 4000, 1500)
    return state.select(*KEEP, "source", cursor.scalar().alias("cursor"))


@query(
    "M8_stale_derived_data",
    """select * from (select user_id, id, max(case when origin='local' then updated_at end) local_at, max(case when origin='remote' then updated_at end) remote_at from changes_v where tbl='view' group by all) where local_at < remote_at""",
)
def m8(v: Views):
    m = v.changes.where("tbl = 'view'").select("user_id", "id", F.col("updated_at").alias("at"), "origin")
    return R.stale(m.where(LOCAL), m.where(REMOTE))


@query(
    "M9_replace_set_write",
    """with old as (select distinct paper_id, sid, category from annotations_v where category='purchase'),
       nw as (select distinct paper_id, case when e>25 then '0.0' else sid end sid, category from annotations_v where category='click' and s=3)
       select * from old where paper_id not in (select paper_id from nw) union all select nw.* from nw semi join sentences_v s on s.paper_id=nw.paper_id and s.sid=nw.sid""",
)
def m9(v: Views):
    cols = ["paper_id", "sid", "category"]
    old = v.annotations.where("category = 'purchase'").select(*cols).distinct()
    new = v.annotations.where("category = 'click' and s = 3")
    new = new.select("paper_id", F.when(F.col("e") > 25, "0.0").otherwise(F.col("sid")).alias("sid"), "category").distinct()
    return R.replace_rows(old, new, v.sentences)


@query(
    "M9_replace_set_store",
    """with old as (select distinct paper_id, sid, category from annotations_v where category='purchase'),
       nw as (select distinct paper_id, case when e>25 then '0.0' else sid end sid, category from annotations_v where category='click' and s=3),
       kept as (select * from old where paper_id not in (select paper_id from nw) union all select nw.* from nw semi join sentences_v s on s.paper_id=nw.paper_id and s.sid=nw.sid)
       select 'set' part, paper_id, sid, category as value from kept
       union all select 'legacy', id, null, case when id not in (select paper_id from nw) then title end from papers_v""",
)
def m9_store(v: Views):
    """The same write on files: sets replaced in place, the papers' legacy column cleared, both read back."""
    cols = ["paper_id", "sid", "category"]
    old = v.annotations.where("category = 'purchase'").select(*cols).distinct()
    new = v.annotations.where("category = 'click' and s = 3")
    new = new.select("paper_id", F.when(F.col("e") > 25, "0.0").otherwise(F.col("sid")).alias("sid"), "category").distinct()
    base = f"{ensure_checkpoint_dir(v.spark).rstrip('/')}/sets-{uuid.uuid4().hex}"
    sets, papers = f"{base}/highlights", f"{base}/papers"
    replace_sets.create(old, sets, buckets=16)
    replace_sets.create(v.papers.select(F.col("id").alias("paper_id"), F.col("title").alias("legacy")), papers, buckets=16)
    # The legacy form goes after the new one is written, so that a lost run never leaves a paper with neither.
    replace_sets.replace(sets, new, v.sentences, buckets=16)
    replace_sets.clear_column(papers, new, "legacy", buckets=16)
    kept = replace_sets.read(v.spark, sets).select(F.lit("set").alias("part"), "paper_id", "sid", F.col("category").alias("value"))
    return kept.unionByName(
        replace_sets.read(v.spark, papers).select(
            F.lit("legacy").alias("part"), "paper_id", F.lit(None).cast("string").alias("sid"), F.col("legacy").alias("value")
        )
    )


@query(
    "M11_reference_nulling",
    "select k, name, case when parent like '%4' or parent like '%7' then '' else coalesce(parent, '') end parent from tree_v",
)
def m11(v: Views):
    dead = v.tree.withColumn("deleted", F.col("k").endswith("4") | F.col("k").endswith("7"))
    return R.null_references(v.tree, "parent", dead, "k").select("k", "name", F.coalesce("parent", F.lit("")).alias("parent"))


@query(
    "M12_tenant_filter",
    "select user_id, tbl, id, rev from changes_v where user_id in (select user_id from ev_v where event_type='signup' and value > 50)",
)
def m12(v: Views):
    signed_in = v.ev.where("event_type = 'signup' and value > 50").select("user_id")
    return R.visible(v.changes, signed_in).select("user_id", "tbl", "id", "rev")


@query(
    "M13_revision_stamp",
    "select user_id, rev, row_number() over (partition by user_id order by rev) revision from changes_v",
)
def m13(v: Views):
    return R.stamp_revisions(v.changes.select("user_id", "rev"), "rev", 1_000_000)


@query(
    "M14_full_refresh",
    """select tbl||':'||id as key, tbl, id from (select distinct tbl, cast(id as varchar) id from changes_v union all select 'gen', cast(id as varchar) from papers_v where not deleted
       union all select 'model', cast(id as varchar) from papers_v where not deleted and rating>2 union all select 'file', cast(id as varchar) from papers_v where not deleted and has_file)""",
)
def m14(v: Views):
    return R.everything(v.changes, v.papers.withColumn("has_model", F.col("rating") > 2))


@query(
    "M15_upsert_keeping_creation",
    """with s as (select id, title meta, 1000+id saved_at, 2000+id updated_at, case when id%4=0 then id end paper_id, id%9=0 deleted from works_v where id%3<>0),
       a as (select id, max(title) meta from registry_v where doi is not null group by id)
       select coalesce(s.id, a.id) id, coalesce(a.meta, s.meta) meta, coalesce(saved_at, 9999) saved_at, case when a.id is not null then 9999 else updated_at end updated_at, coalesce(paper_id, -1) paper_id, case when a.id is not null then false else deleted end deleted from s full join a on a.id=s.id""",
)
def m15(v: Views):
    saved = v.works.where("id % 3 <> 0").selectExpr(
        "id", "title meta", "1000+id saved_at", "2000+id updated_at", "case when id%4=0 then id end paper_id", "id%9=0 deleted"
    )
    again = v.registry.where("doi is not null").select("id", F.col("title").alias("meta"))
    out = R.save_works(saved, again, F.lit(9999).cast("bigint"))
    return out.withColumn("paper_id", F.coalesce("paper_id", F.lit(-1)))


@query(
    "U4_keyed_union_left_preference",
    """with l as (select user_id, tbl, id, arg_max("data", rev) "data" from changes_v where origin='local' group by all), r as (select user_id, tbl, id, arg_max("data", rev) "data" from changes_v where origin='remote' group by all)
       select coalesce(l.user_id, r.user_id) user_id, coalesce(l.tbl, r.tbl) tbl, coalesce(l.id, r.id) id, coalesce(l."data", r."data") "data" from l full join r on l.user_id=r.user_id and l.tbl=r.tbl and l.id=r.id""",
)
def u4(v: Views):
    def side(where):
        return v.changes.where(where).groupBy(*R.KEY).agg(F.max_by("data", "rev").alias("data"))

    return R.merge_prefer_left(side(LOCAL), side(REMOTE), R.KEY)


@query(
    "S11_paged_listing",
    "select user_id, rev, (row_number() over (partition by user_id order by rev)-1)//50 page from changes_v where not deleted",
)
def s11(v: Views):
    live = v.changes.where("not deleted").select("user_id", "rev")
    return R.listing_pages(live, ["user_id"], "rev", 50, 1_000_000)


_PAYLOAD = """rows_ as (select user_id, rev//400 batch, rev seq, length(event_type)*20+k chars, row_number() over (partition by user_id, rev//400 order by rev) i from (select user_id, event_id rev, event_type, k from ev_v))"""


@query(
    "S12_upload_chunking",
    f"""with recursive {_PAYLOAD}, walk as (select user_id, batch, seq, chars, i, 1 part, chars used from rows_ where i=1
       union all select r.user_id, r.batch, r.seq, r.chars, r.i, w.part+case when w.used+r.chars>300 then 1 else 0 end, case when w.used+r.chars>300 then 0 else w.used end+r.chars from walk w join rows_ r on r.user_id=w.user_id and r.batch=w.batch and r.i=w.i+1)
       select user_id, batch, seq, chars, part from walk""",
)
def s12(v: Views):
    payload = F.rpad(F.lit(""), (F.length("event_type") * 20 + F.col("k")).cast("int"), F.lit("x"))
    rows = v.ev.select("user_id", F.floor(F.col("event_id") / 400).alias("batch"), F.col("event_id").alias("seq"), payload.alias("payload"))
    return R.upload_parts(rows, 300)


@query(
    "G8_reconciliation_report",
    """select l.local_papers, l.local_files, r.remote_papers, r.remote_files, pending, case when local_papers>remote_papers then 'upload all' when remote_papers>local_papers then 'download all' else 'in step' end advice
       from (select count(*) filter (not deleted) local_papers, count(*) filter (has_file) local_files from papers_v where rating<>0) l, (select count(*) filter (not deleted) remote_papers, count(*) filter (has_file) remote_files from papers_v where rating<>1) r,
       (select count(*) pending from (select distinct user_id, tbl, id from changes_v where origin='local'))""",
)
def g8(v: Views):
    pending = v.changes.where(LOCAL).select(*R.KEY).distinct()
    return R.reconcile(v.papers.where("rating <> 0"), v.papers.where("rating <> 1"), pending)


def bundles_of(v: Views):
    t = v.translations.withColumn("c", F.when(F.length("sid") > 3, F.lit("gap")))
    picks = v.annotations.where("category = 'purchase'").groupBy("paper_id", "sid").agg(F.min("category").alias("c"))
    status = v.translations.groupBy("paper_id", "page").agg(F.bool_and(F.col("t").isNotNull()).alias("done"))
    epochs = v.papers.select(F.col("id").alias("paper_id"), F.col("rating").alias("epoch"))
    return R.build_bundles(t, picks, status, epochs)


@query(
    "G7_bundle_build",
    """with t as (select *, case when length(sid)>3 then 'gap' end c from translations_v), tt as (select paper_id, count(*) n_t, md5(string_agg(sid||'='||t, ';' order by sid)) t_hash from t where not mock and t is not null and t<>'' group by 1),
       cc as (select paper_id, sid, arg_max(c, p) c from (select paper_id, sid, 0 p, c from t where c is not null union all select distinct paper_id, sid, 1, 'purchase' from annotations_v where category='purchase') group by all),
       c2 as (select paper_id, count(*) n_c, md5(string_agg(sid||'='||c, ';' order by sid)) c_hash from cc group by 1),
       pg as (select paper_id, string_agg(cast(page as varchar), ',' order by page) pages from (select paper_id, page from t group by all having bool_and(t is not null) and not bool_or(mock)) group by 1)
       select p.id paper_id, rating epoch, coalesce(n_t, 0) n_t, coalesce(t_hash, md5('')) t_hash, coalesce(n_c, 0) n_c, coalesce(c_hash, md5('')) c_hash, coalesce(pages, '') pages from papers_v p left join tt on tt.paper_id=p.id left join c2 on c2.paper_id=p.id left join pg on pg.paper_id=p.id
       where coalesce(n_t,0)>0 or coalesce(n_c,0)>0 or coalesce(pages,'')<>'' or rating<>0""",
)
def g7(v: Views):
    def digest(m):
        return F.md5(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value)), ";"))

    return bundles_of(v).select(
        "paper_id", "epoch", F.size("t").alias("n_t"), digest("t").alias("t_hash"), F.size("c").alias("n_c"), digest("c").alias("c_hash"),
        F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"),
    )


@query(
    "S10_backup_restore",
    """select 'papers' tbl, count(*) n, count(distinct id) "keys" from papers_v union all select 'highlights', count(*), count(distinct id) from annotations_v
       union all select 'saved', count(*), count(distinct id) from works_v""",
)
def s10(v: Views):
    tables = {"papers": v.papers, "highlights": v.annotations, "saved": v.works}
    dump = B.dump_tables(tables)
    out = None
    for name, df in tables.items():
        back = B.restore_table(dump, name, df.schema, ["id"], df.limit(0))
        one = back.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.count_distinct("id").alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "S10_restore_over_rows",
    """select id, title, journal, n_authors, yr, doi, rating from papers_v union all select -1-id, title||' (new)', journal, n_authors, yr, doi, rating from papers_v""",
)
def s10_over(v: Views):
    # Since the backup a third of the papers were lost, a third renamed, and as many came in.
    papers = v.papers.select("id", "title", "journal", "n_authors", "yr", "doi", "rating")
    dump = B.dump_tables({"papers": papers})
    since = papers.where("id % 3 <> 0").withColumn("title", F.when(F.col("id") % 3 == 1, "renamed").otherwise(F.col("title")))
    added = papers.withColumn("id", -1 - F.col("id")).withColumn("title", F.concat("title", F.lit(" (new)")))
    return B.restore_table(dump, "papers", papers.schema, ["id"], since.unionByName(added))
