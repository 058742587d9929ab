"""Queries L4, L9, L10, L12, L13, L15, L18, L20, L21 over lines and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.fixtures import Views
from quire.operators import blocks as B
from quire.plans.registry import query


@query(
    "L4_body_statistics",
    """with f as (select paper_id, floor(fs*2+0.5)/2 v, sum(length(str)) w, min(ix) p from text_items_v group by all), g as (select paper_id, font v, sum(length(str)) w, min(ix) p from text_items_v group by all)
       select a.paper_id, body_fs, body_font from (select paper_id, arg_max(v, row(w, -p)) body_fs from f group by 1) a join (select paper_id, arg_max(v, row(w, -p)) body_font from g group by 1) b using (paper_id)""",
)
def l4(v: Views):
    return B.body_style(v.text_items)


@query(
    "L9_join_lines_dehyphenate",
    r"""select paper_id, block, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])[-\x{ad}]\x01([a-z])', '\1\2', 'g'), '([A-Za-z])[-\x{ad}]\x01([a-z])', '\1\2', 'g'),
         '([\x{2e80}-\x{9fff}\x{ff00}-\x{ffef}])\x01', '\1', 'g'), '\x01([\x{2e80}-\x{9fff}\x{ff00}-\x{ffef}])', '\1', 'g'), chr(1), ' ') as text
       from (select paper_id, line_no//5 block, string_agg(case when line_no%3=0 then trim(text)||'ing-' else trim(text) end, chr(1) order by line_no) t from (select paper_id, line_no, case when line_no%3=1 then lower(text) else text end as text from lines_v) group by all)""",
)
def l9(v: Views):
    # Every third line is given a line-end hyphen, and the next one a lower-case start.
    text = F.when(F.col("line_no") % 3 == 0, F.concat("text", F.lit("ing-"))).when(F.col("line_no") % 3 == 1, F.lower("text")).otherwise(F.col("text"))
    lines = v.lines.select("paper_id", F.floor(F.col("line_no") / 5).alias("block"), "line_no", text.alias("text"))
    return B.block_texts(lines, "paper_id", "block")


BLOCK_SQL = """bl as (select paper_id, source, line_no, text, cast(line_no as double) n, 1+length(text)//100 n_lines, 54.0::double x0, 72.0::double+12.0*(line_no%52) y0,
   54.0::double+least(5.0::double*length(text), 500.0) x1, 82.0::double+12.0*(line_no%52) y1, case when line_no=0 then 14.0::double when paper_id%7=0 and line_no%9=8 then 8.0 else 10.0 end fs,
   case when line_no=0 then 'B' else 'T' end font, paper_id%4=0 and line_no%11=5 tbl, 612.0::double w, 792.0::double h, 10.0::double body_fs, 'T' body_font from lines_v)"""


def line_blocks(v: Views):
    """Lines as blocks with a plain geometry."""
    row = F.col("line_no") % 52
    return v.lines.select(
        "paper_id", "source", "lang", "line_no", "text", F.col("line_no").cast("double").alias("n"),
        (1 + F.floor(F.length("text") / 100)).alias("n_lines"), F.lit(54.0).alias("x0"), (72.0 + 12.0 * row).alias("y0"),
        (54.0 + F.least(5.0 * F.length("text"), F.lit(500.0))).alias("x1"), (82.0 + 12.0 * row).alias("y1"),
        F.when(F.col("line_no") == 0, 14.0).when((F.col("paper_id") % 7 == 0) & (F.col("line_no") % 9 == 8), 8.0).otherwise(10.0).alias("fs"),
        F.when(F.col("line_no") == 0, "B").otherwise("T").alias("font"),
        ((F.col("paper_id") % 4 == 0) & (F.col("line_no") % 11 == 5)).alias("tbl"),
        F.lit(612.0).alias("w"), F.lit(792.0).alias("h"), F.lit(10.0).alias("body_fs"), F.lit("T").alias("body_font"),
    )


_LET = r"[A-Za-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
CLASSIFY_SQL = rf"""{BLOCK_SQL}, c1 as (select *, trim(text) t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x<>'')) words, len(regexp_extract_all(trim(text), '{_LET}')) letters,
   length(regexp_replace(trim(text), '\s', '', 'g')) compact, regexp_matches(trim(text), '[.?!。？！]["”’)\]]?\z') term, x1-x0 wd, (x0+x1)/2 cx from bl),
 c2 as (select *, case when wd>0.55*w then w else w/2 end col, case when wd>0.55*w or cx<w/2 then 0 else w/2 end lft from c1),
 c3 as (select *, abs(cx-(lft+col/2)) < 0.04*w and wd < 0.7*col cen from c2),
 cl as (select *, case when letters<2 or letters<0.4*compact then 'skip' when (y1<0.085*h or y0>0.925*h) and length(t)<160 and n_lines<=2 then 'skip'
   when regexp_matches(t, '{B.BOILERPLATE}') and length(t)<400 then 'skip' when regexp_matches(t, '{B.CAPTION}') then 'caption'
   when tbl then case when words<=5 and not term then 'label' else 'para' end
   when n_lines<=3 and words<=25 and not term and (fs>=body_fs*1.12 or font<>body_font or cen) then 'heading'
   when n_lines=1 and words<=12 and not term and wd<0.6*col then case when fs<body_fs*0.95 then 'label' else 'heading' end
   when fs<body_fs*0.92 and words<8 and not term then 'label' when n_lines<=2 and words<=6 and not term then 'label' else 'para' end kind from c3)"""


@query("L10_block_classification", f"with {CLASSIFY_SQL} select paper_id, line_no, kind, not tbl and kind not in ('skip','caption') and cen centered from cl")
def l10(v: Views):
    return B.classify(line_blocks(v)).select("paper_id", "line_no", "kind", "centered")


def source_pages(v: Views):
    """Documents as pages of their source: the first and the last two lines are the page's edge.

    Every third page shows its number in front of its first line.
    """
    page = F.floor(F.col("doc") / 20)
    b = v.lines_to_last.withColumnRenamed("paper_id", "doc")
    text = F.when((F.col("line_no") == 0) & (F.col("doc") % 3 == 0), F.concat((100 + page).cast("string"), F.lit(" "), F.substring_index("text", " ", 3))).otherwise(F.col("text"))
    return b.select(
        "doc", F.col("source").alias("paper_id"), page.alias("page"), F.col("line_no").alias("n"), text.alias("text"),
        ((F.col("line_no") == 0) | (F.col("line_no") >= F.col("last_line") - 1)).alias("edge"),
    )


_SP = """ll as (select paper_id doc, max(line_no) last_line from lines_v group by 1),
 sp as (select source paper_id, paper_id//20 page, line_no n, case when line_no=0 and paper_id%3=0 then cast(100+paper_id//20 as varchar)||' '||array_to_string(string_split(text,' ')[1:3], ' ') else text end as text,
   line_no=0 or line_no>=last_line-1 edge from lines_v l join ll on ll.doc=l.paper_id), np as (select source paper_id, count(*) n_pages from documents group by 1)"""


def page_totals(v: Views):
    return v.documents.groupBy(F.col("source").alias("paper_id")).agg(F.count("*").alias("n_pages"))


@query(
    "L12_running_headers",
    rf"""with {_SP}, k as (select *, case when edge then array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' '), lambda x: length(x)>1), ' ') end kk from sp),
      rep as (select paper_id, kk, count(distinct page) c from k where length(kk)>=4 group by all), hit as (select rep.paper_id, kk from rep join np using (paper_id) where c >= greatest(3, ceil(n_pages*0.25)))
      select k.paper_id, page, n, edge, hit.kk is not null running from k left join hit on hit.paper_id=k.paper_id and hit.kk=k.kk""",
)
def l12(v: Views):
    return B.running_headers(source_pages(v), page_totals(v)).select("paper_id", "page", "n", "edge", "running")


_CANDS = rf"""{_SP}, e as (select *, trim(text) t from sp where edge and length(trim(text))<=160 and not regexp_matches(trim(text), '{B.BOILERPLATE}')),
 raw as (select paper_id, page, n, t, 0 i, regexp_extract(t, '(\d{{1,4}})\s*[-–]\s*\d{{1,4}}\s*\z', 1) d from e union all select paper_id, page, n, t, 1, regexp_extract(t, '^\s*(\d{{1,4}})(?:\D|\z)', 1) from e
   union all select paper_id, page, n, t, 2, regexp_extract(t, '(?:^|\D)(\d{{1,4}})\s*\z', 1) from e),
 cand as (select paper_id, page, cast(d as int) c, min(row(n, i)) "at" from raw where d<>'' and (i=0 or (cast(d as int)>0 and not (cast(d as int) between 1900 and 2099 and length(t)>4))) group by all),
 votes as (select paper_id, c-page off, count(*) votes from cand group by all),
 off as (select paper_id, b[2] page_offset, b[1] votes from (select paper_id, max(row(votes, off)) b from votes group by 1) join np using (paper_id) where b[1] >= case when n_pages<=2 then 1 else 2 end)"""


@query("L13_page_offset", f"with {_CANDS} select * from off")
def l13(v: Views):
    return B.page_numbers(source_pages(v).where("edge"), page_totals(v))[0]


@query(
    "L13_page_numbers",
    f"""with {_CANDS} select paper_id, page, coalesce(max(case when c=page+page_offset then c end), arg_min(c, "at")) printed from cand left join off using (paper_id) group by all""",
)
def l13b(v: Views):
    return B.page_numbers(source_pages(v).where("edge"), page_totals(v))[1]


@query(
    "L15_sentence_assembly",
    """with p as (select paper_id, (ord-1)//3 sentence, line_no block_no, page, cast(sum(length(text)) as bigint) chars, min(ord) "at" from (select r.*, cast(floor(line_no/5) as bigint) page, row_number() over (partition by paper_id order by line_no, j) ord from rawsent_v r) group by all),
       h as (select paper_id, sentence, arg_max(row(block_no, page), row(chars, -"at")) home, min("at") f from p group by all)
       select paper_id, sentence, home[1] block_no, home[2] page, cast(home[2]+1 as varchar)||'.'||cast(row_number() over (partition by paper_id, home[2] order by home[1], f) as varchar) sid from h""",
)
def l15(v: Views):
    # Three pieces in a row stand for a sentence that runs through several lines.
    p = v._pieces().select("paper_id", F.floor((F.col("ord") - 1) / 3).alias("sentence"), F.col("line_no").alias("block_no"), "page", "ord", F.length("text").alias("len"))
    parts = p.groupBy("paper_id", "sentence", "block_no", "page").agg(F.sum("len").alias("chars"), F.min("ord").alias("at"))
    return B.assign_homes(parts)


@query(
    "L18_title_guess",
    r"""with c as (select paper_id, line_no, trim(text) t, len(regexp_split_to_array(text, '\s+')) w from lines_v where line_no < 3)
       select paper_id, coalesce(max(case when line_no=2 then t end), max(case when line_no=0 then t end), max(t)) title from c where w between 3 and 40 group by paper_id""",
)
def l18(v: Views):
    sizes = F.element_at(F.array(F.lit(12.0), F.lit(12.4), F.lit(13.0)), (F.col("line_no") + 1).cast("int"))
    b = v.lines.where("line_no < 3").select(
        "paper_id", F.lit(0).alias("page"), F.col("line_no").alias("n"), "text", F.lit("heading").alias("kind"), sizes.alias("fs"), F.lit(10.0).alias("body_fs")
    )
    return B.guess_title(b)


HINT_LINE = "concat('Review X ISSN: 0022-2', cast(100+paper_id%900 as {s}), ' and 1547-', cast(5000+paper_id%4000 as {s}), ' (Online) Vol. ', cast(1+paper_id%40 as {s}), ' (March ', cast(1940+paper_id%120 as {s}), '), ', cast(1+paper_id%300 as {s}), '–', cast(5+paper_id%310 as {s}))"


@query(
    "L20_citation_hints",
    rf"""with h as (select doc_id paper_id, string_split(text, chr(10))[1:15] a from documents), l as (select paper_id, list_append(list_transform(a, lambda x: trim(x)), {HINT_LINE.format(s='varchar')}) a from h),
      t as (select *, array_to_string(a, chr(10)) al from l),
      i as (select paper_id, list_distinct(list_transform(regexp_extract_all(al, 'ISSN[:\s]*((?:\d{{4}})-?(?:\d{{3}}[\dXx]))', 1), lambda x: upper(x))) i1, list_transform(regexp_extract_all(al, '(?i)\b(\d{{4}}-\d{{3}}[\dXx])\s*\((?:print|online|electronic)\)', 1), lambda x: upper(x)) i2 from t)
      select paper_id, array_to_string(list_concat(i1, list_filter(i2, lambda x: not list_contains(i1, x))), ',') issn,
       case when 1940+paper_id%120 between 1950 and 2049 then 1940+paper_id%120 else -1 end "year", cast(1+paper_id%40 as varchar) volume,
       case when 5+paper_id%310 > 1+paper_id%300 and (5+paper_id%310)-(1+paper_id%300) < 250 then cast(1+paper_id%300 as varchar) else '' end first_page from i""",
)
def l20(v: Views):
    d = v.documents.select(F.col("doc_id").alias("paper_id"), F.transform(F.slice(F.split("text", "\n"), 1, 15), lambda x: F.trim(x)).alias("a"))
    lines = F.array_append("a", F.expr(HINT_LINE.format(s="string")))
    heads = F.transform("a", lambda x, i: F.struct(F.when(i == 0, 14.0).otherwise(10.0).alias("fs"), i.alias("i"), x.alias("text")))
    null = F.lit(None).cast("string")
    h = d.select("paper_id", B.citation_hints(lines, heads, null, null, null, F.lit(None).cast("int")).alias("h"))
    return h.select(
        "paper_id", F.array_join("h.issn", ",").alias("issn"), F.coalesce("h.year", F.lit(-1)).alias("year"), "h.volume",
        F.coalesce("h.first_page", F.lit("")).alias("first_page"),
    )


@query(
    "L21_outline",
    rf"""with s0 as (select * replace (case when ord%12=5 and length(text)<120 then 'heading' else kind end as kind) from sentences_v), s as (select *, case when kind='heading' then 10.0+ord%9 else 10.0 end fs, ord%5=0 cen from s0), r as (select *, kind in ('heading','label') f from s),
      i as (select *, row_number() over (partition by paper_id order by ord)-row_number() over (partition by paper_id, f order by ord) isl from r),
      w as (select *, f and count(*) over (partition by paper_id, f, isl)>=3 in_run, coalesce(max(kind='para' and length(text)>=60) over (partition by paper_id order by ord rows between 1 following and 8 following), false) soon,
        min(case when kind='para' and length(text)>60 then ord end) over (partition by paper_id) fp from i)
      select paper_id, sid, case when fs>=12.5 or cen or regexp_matches(text, '(?i)^(references?|bibliography|參考文獻)$') then 1 else 2 end as level, page from w
      where kind='heading' and not in_run and (fp is null or ord>=fp) and fs>=9.7 and fs<18 and length(text)>=2 and not regexp_matches(text, '{B.NOT_HEADING}')
       and regexp_matches(text, '^[\p{{Lu}}\p{{N}}\p{{Han}}]') and not (regexp_matches(text, '\.\s+\S') or (length(text)>60 and fs<11.5)) and soon""",
)
def l21(v: Views):
    # One sentence in twelve is set as a heading of varying size.
    heading = (F.col("ord") % 12 == 5) & (F.length("text") < 120)
    s = v.sentences.withColumn("kind", F.when(heading, "heading").otherwise(F.col("kind")))
    s = s.withColumn("fs", F.when(F.col("kind") == "heading", 10.0 + F.col("ord") % 9).otherwise(10.0))
    return B.outline(s.withColumn("body_fs", F.lit(10.0)).withColumn("centered", F.col("ord") % 5 == 0))
