"""Flagship: clean sentences per source and language.

Lines become blocks and are classified, repeated page edges are found per source, both are
dropped, and what is left of every document is joined, segmented and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import Views
from quire.functions.sentences import segment_table
from quire.operators import blocks as B
from quire.plans.blocks import CLASSIFY_SQL, _SP, line_blocks, page_totals, source_pages
from quire.plans.registry import query
from quire.plans.text import SEGMENT_SQL


def clean_sentences(v: Views) -> DataFrame:
    """(source, lang, doc_id, n, sentence) of kept lines only."""
    v = v.by_paper
    # The kind is made by a generator: as a plain column it would be made in the filter, where no part of it is shared.
    kinds = B.classify(line_blocks(v)).select("paper_id", "source", "lang", "line_no", "text", F.explode_outer(F.array("kind")).alias("kind"))
    kinds = kinds.where("kind <> 'skip'").drop("kind")
    # Only a line at the edge of its page can be a running one, so no other line is moved.
    edges = B.running_headers(source_pages(v).where("edge"), page_totals(v)).where("running")
    repeated = edges.select(F.col("doc").alias("paper_id"), F.col("n").alias("line_no"))
    kept = kinds.join(repeated, ["paper_id", "line_no"], "left_anti")
    texts = B.block_texts(kept, "paper_id", "source", "lang")
    return segment_table(texts, "text", "source", "lang", "paper_id")


def clean_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean_sentences(Views(spark, sf_dir))
    return s.groupBy("source", "lang").agg(
        F.count("*").alias("sentences"), F.count_distinct("paper_id").alias("documents"), F.sum(F.length("sentence")).alias("chars")
    )


_SEG = SEGMENT_SQL.replace("from documents)", "from clean)", 1)
_CLASS = CLASSIFY_SQL


@query(
    "flagship_clean_sentences",
    rf"""with {_CLASS}, {_SP.replace('select source paper_id, paper_id//20 page,', 'select paper_id doc, source paper_id, paper_id//20 page,')},
      k as (select *, case when edge then array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' '), lambda x: length(x)>1), ' ') end kk from sp),
      rep as (select paper_id, kk, count(distinct page) c from k where length(kk)>=4 group by all), hit as (select rep.paper_id, kk from rep join np using (paper_id) where c >= greatest(3, ceil(n_pages*0.25))),
      gone as (select k.doc, k.n from k join hit on hit.paper_id=k.paper_id and hit.kk=k.kk),
      keep_lines as (select cl.* from cl where kind<>'skip' and not exists (select 1 from gone where gone.doc=cl.paper_id and gone.n=cl.line_no)),
      j as (select paper_id doc_id, string_agg(trim(text), chr(1) order by line_no) t from keep_lines group by 1),
      clean as (select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])[-\x{{ad}}]\x01([a-z])', '\1\2', 'g'), '([A-Za-z])[-\x{{ad}}]\x01([a-z])', '\1\2', 'g'),
         '([\x{{2e80}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}])\x01', '\1', 'g'), '\x01([\x{{2e80}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}])', '\1', 'g'), chr(1), ' ') as text from j),
      {_SEG} select source, lang, count(*) sentences, count(distinct doc_id) documents, cast(sum(length(sentence)) as bigint) chars from sents join documents using (doc_id) group by all""",
)
def flagship(v: Views):
    return clean_sentence_counts(v.spark, v.dir)
