"""Queries over the library, the works and the citation graph: Q1, Q4-Q9, G2, J4, J14, J15, W9, U3."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.fixtures import Views
from quire.operators import graph as G
from quire.operators import library as L
from quire.plans.registry import query


def tagged(v: Views):
    return v.papers.join(
        v.documents.select(F.col("doc_id").alias("id"), F.array("lang", F.concat(F.lit("r"), (F.col("doc_id") % 6).cast("string"))).alias("tags")),
        "id",
    )


@query(
    "Q1_library_search",
    """select id, title, rank from (select id, title, row_number() over (order by coalesce(last_opened_at, 0) desc, id) rank from papers_v where not deleted and folder_id=2
       and (contains(lower(title),'en') or contains(lower(journal),'en') or contains(lower(coalesce(doi,'')),'en')) and rating>=1 and has_file) where rank between 21 and 40""",
)
def q1(v: Views):
    found = L.search_library(v.papers, folder=2, text="En", min_rating=1, recent=True).where("has_file")
    page = L.library_page(found, page=2)
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("sort_key"), "id")  # twenty rows
    return page.select("id", "title", (20 + F.row_number().over(w)).alias("rank"))


@query(
    "Q4_recent_and_prefetch",
    """select 'recent' list, id from (select id from papers_v where not deleted and coalesce(last_opened_at,0)<>0 order by last_opened_at desc, id limit 25)
       union all select 'prefetch', id from (select id from papers_v where has_file and not deleted order by coalesce(last_opened_at, added_at) desc, id limit 20)""",
)
def q4(v: Views):
    return L.recent_papers(v.papers).select(F.lit("recent").alias("list"), "id").unionByName(
        L.prefetch_papers(v.papers).select(F.lit("prefetch").alias("list"), "id")
    )


@query("Q5_soft_delete_filter", "select user_id, tbl, id, rev from changes_v where not deleted")
def q5(v: Views):
    from quire.operators.annotations import live

    return live(v.changes).select("user_id", "tbl", "id", "rev")


@query(
    "G2_library_facets",
    """with p as (select p.*, [lang, 'r'||cast(doc_id%6 as varchar)] tags from papers_v p join documents d on d.doc_id=p.id where not deleted),
       k as (select 'tag' facet, unnest(tags) as value from p union all select 'folder', cast(folder_id as varchar) from p
        union all select 'unread', cast(folder_id as varchar) from p where coalesce(last_opened_at,0)=0)
       select facet, value, count(*) n from k group by all""",
)
def g2(v: Views):
    return L.facets(tagged(v))


OWNED = "owned as (select doi from hints_v where id%3=0 and doi is not null)"
TYPES = ("ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL")
_TYPES = ",".join(f"'{t}'" for t in TYPES)


def owned(v: Views):
    return v.hints.where("id%3 = 0 and doi is not null").select("doi")


@query(
    "J14_in_library_flag",
    f"with {OWNED} select id, cast(id as varchar) work_key, doi is not null and doi in (select doi from owned) in_library from works_v",
)
def j14(v: Views):
    return G.flag_owned(v.works, owned(v))


@query(
    "U3_owned_difference",
    f"with {OWNED} select id from works_v where doi is null or doi not in (select doi from owned)",
)
def u3(v: Views):
    return G.not_owned(v.works, owned(v)).select("id")


# A work's first author stands in its title, turned round; every fifth work names none.
FAMILY = "case when id%5=0 then null when id%3=1 then lower({n}) else {n} end family"


@query(
    "J15_citation_neighbours",
    f"""with w as (select id, cited_by, {FAMILY.format(n="concat(upper(split_part(title,' ',2)[1]), split_part(title,' ',2)[2:], split_part(title,' ',1))")} from works_v),
       r as (select src seed, dst work from edges_v qualify row_number() over (partition by src order by dst) <= 150),
       refs as (select seed, work, row_number() over (partition by seed order by lower(coalesce(family,'')), coalesce(family,'') desc, work) rank, cited_by, 'reference' direction from r join w on id=work),
       c as (select dst seed, src work, cited_by, row_number() over (partition by dst order by cited_by desc, src) rank from edges_v join w on id=src qualify rank <= 25)
       select seed, work, rank, cited_by, direction from refs union all select seed, work, rank, cited_by, 'cited_by' from c""",
)
def j15(v: Views):
    name = "concat(initcap(split_part(title,' ',2)), split_part(title,' ',1))"
    return G.neighbours(v.edges, v.works.selectExpr("id", "cited_by", FAMILY.format(n=name)))


@query(
    "Q6_trending",
    f"""with {OWNED} select w.id, cited_by, tier, '近三年，被引用 '||cast(cited_by as varchar)||' 次' reason from works_v w join journals_v j on j.name=w.journal
       where yr >= 2021 and wtype in ({_TYPES}) and (doi is null or doi not in (select doi from owned)) order by cited_by desc, w.id limit 15""",
)
def q6(v: Views):
    return G.trending(v.works, v.journals, owned(v), 2021, TYPES)


@query(
    "Q6_trending_all_journals",
    f"""with {OWNED} select w.id, cited_by, tier, '近三年，被引用 '||cast(cited_by as varchar)||' 次' reason from works_v w left join journals_v j on j.name=w.journal
       where yr >= 2021 and wtype in ({_TYPES}) and (doi is null or doi not in (select doi from owned)) order by cited_by desc, w.id limit 15""",
)
def q6_all(v: Views):
    return G.trending(v.works, v.journals, owned(v), 2021, TYPES, only_listed=False)


RELATED_SQL = f"""{OWNED},
 citing as (select dst seed, src work from edges_v join works_v on id=src qualify row_number() over (partition by dst order by cited_by desc, src) <= 30),
 refs as (select src seed, dst work from edges_v qualify row_number() over (partition by src order by dst) <= 50),
 given as (select id seed, id+1 work, 'related' source from works_v union all select id, id+2, 'related' from works_v
   union all select id, id+5, 'search' from works_v union all select id, id+11, 'topic' from works_v),
 cand as (select distinct * from (select seed, work, 'cites' source from citing union all select seed, work, 'ref' from refs union all select * from given) where seed<>work),
 sets as (select seed, work, sum(case source when 'cites' then 3 when 'related' then 2 when 'ref' then 1.5 when 'topic' then 2.5 else 1.5 end)::double base,
   concat_ws('、', max(case source when 'cites' then '引用了本篇' end), max(case source when 'related' then 'OpenAlex 相關作品' end), max(case source when 'ref' then '本篇的參考文獻' end),
    max(case source when 'topic' then '符合你的研究主題' end), max(case source when 'search' then '與本篇關鍵詞相符' end)) reason from cand group by all),
 scored as (select seed, work, reason, tier, round(log10(cited_by+1.0) + case tier when 1 then 2 when 2 then 1.5 else 0.5 end + greatest(0.0, 1-(2024-yr)/25.0) + base, 9) pre
   from sets join works_v w on w.id=work join journals_v j on j.name=w.journal where wtype in ({_TYPES}) and (doi is null or doi not in (select doi from owned))),
 pool as (select *, row_number() over (partition by seed order by pre desc, work) r from scored qualify r <= 30),
 norm as (select *, floor(pre / greatest(1.0, max(pre) over (partition by seed)) * 80 + 0.5)::bigint score from pool)"""


def related_candidates(v: Views):
    ids = v.works.select(F.col("id").alias("seed"))
    lists = F.array(*[F.struct((F.col("seed") + d).alias("work"), F.lit(s).alias("source")) for d, s in ((1, "related"), (2, "related"), (5, "search"), (11, "topic"))])
    given = ids.select("seed", F.explode(lists).alias("g")).select("seed", "g.work", "g.source")
    return G.candidates(v.edges, v.works, given)


@query(
    "Q7_related_ranking",
    f"with {RELATED_SQL} select seed, row_number() over (partition by seed order by score desc, r) rank, work, score, tier, reason from norm qualify rank <= 20",
)
def q7(v: Views):
    return G.rank_related(related_candidates(v), v.works, v.journals, owned(v), 2024, TYPES)


@query(
    "Q7_related_rescored",
    f"""with {RELATED_SQL.replace("when 2 then 1.5 else 0.5 end", "when 2 then 1.5 when 3 then 0.5 else 0 end").replace("join journals_v j on", "left join journals_v j on")},
     again as (select seed, r, work, tier, case when (seed+work)%5=0 then least(100, work%130)::bigint else score end score, case when (seed+work)%5=0 then 'asked' else reason end reason from norm)
     select seed, row_number() over (partition by seed order by score desc, r) rank, work, score, tier, reason from again qualify rank <= 20""",
)
def q7_rescored(v: Views):
    """All journals; an outside score and its reason replace every fifth pair's own."""
    pairs = related_candidates(v)
    again = pairs.where("(seed + work) % 5 = 0").select("seed", "work").distinct().select("seed", "work", (F.col("work") % 130).alias("score"), F.lit("asked").alias("reason"))
    return G.rank_related(pairs, v.works, v.journals, owned(v), 2024, TYPES, rescored=again, only_listed=False)


@query(
    "W9_max_normalised_score",
    "select id, floor(cited_by / greatest(1.0, max(cited_by) over (partition by journal)) * 80 + 0.5)::bigint score from works_v",
)
def w9(v: Views):
    # The maximum is an aggregate joined back, so a journal that holds most works is no single task.
    best = v.works.groupBy("journal").agg(F.greatest(F.lit(1.0), F.max("cited_by")).alias("best"))
    return v.works.join(best, "journal").select("id", F.floor(F.col("cited_by") / F.col("best") * 80 + 0.5).alias("score"))


@query(
    "Q9_resumable_work",
    """select id from papers_v join import_v on doc_id=id where has_file and not deleted and not (coalesce(stage,'')='paused' and paused_until > 4500) and coalesce(stage,'') not in ('done','error')""",
)
def q9(v: Views):
    from quire.operators.importing import resumable

    jobs = v.imports.where("stage is not null").select(F.col("doc_id").alias("id"), "stage", "paused_until")
    return resumable(v.papers, jobs, F.lit(4500)).select("id")
