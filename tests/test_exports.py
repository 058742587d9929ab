"""Exports are the same text wherever they are cut, and glossary terms of any script are found."""

import pytest
from pyspark.sql import functions as F

from quire.operators.glossary import first_occurrences
from quire.sources import sinks as K

COUNTS = [1, 499, 500, 501, 1203]


def joined(df, column, *order):
    return "".join(r[column] for r in df.orderBy(*order).collect())


def notes(spark, n):
    return spark.range(n).selectExpr(
        "1 paper_id", "cast(id % 3 as int) page", "cast(id as bigint) ord", "id * 1000 created_at", "id", "concat('line ', id) line", "concat('q', id) quote", "'(A, 2001)' cite",
        "case when id % 2 = 0 then 'src' else 'tgt' end side", "concat('c', id) counterpart", "case when id % 5 = 0 then 'remark' else '' end note",
        "case when id % 4 = 0 then 'gap' end category", "concat('s<', id) source_text", "case when id % 3 = 0 then '' else 't&' end target_text", "'p. 7 L 2' place",
    )


@pytest.mark.parametrize("n", COUNTS)
def test_ris_is_one_note_field(spark, n):
    heads = spark.createDataFrame([(1, "TY  - JOUR\r\n")], "paper_id int, head string")
    rows = sorted(((i % 3, i), f"line {i}") for i in range(n))
    want = "TY  - JOUR\r\nN1  - Highlights<br>" + "<br>".join(t for _, t in rows) + "\r\nER  - \r\n"
    assert joined(K.to_ris(heads, notes(spark, n)), "ris", "part") == want


@pytest.mark.parametrize("n", [2, 700])
def test_markdown_has_a_blank_line_before_each_section(spark, n):
    heads = spark.createDataFrame([(1, "Title", "Ref.")], "paper_id int, title string, reference string")
    explained = spark.range(n).selectExpr("1 paper_id", "concat('why ', id) query", "'because' answer", "id * 1000 created_at", "id")
    free = spark.createDataFrame([(1, "own words")], "paper_id int, text string")
    items = []
    for i in sorted(range(n), key=lambda i: (i % 3, i)):
        other = f"\n  - {'譯文' if i % 2 == 0 else '原文'}：c{i}"
        items.append(f"- “q{i}” (A, 2001)" + other + ("\n  - 評論：remark" if i % 5 == 0 else ""))
    lines = ["# Title", "", "Ref.", "", "## 劃線與評論", "", *items, "", "## 解釋", ""]
    for i in range(n):
        lines += [f"### why {i}", "", "because", ""]
    want = "\n".join([*lines, "## 筆記", "", "own words", ""])
    assert joined(K.to_markdown(heads, notes(spark, n), explained, free), "md", "section", "part") == want


@pytest.mark.parametrize("n", [3, 501])
def test_note_html_has_one_part_a_line(spark, n):
    heads = spark.createDataFrame([(1, "<p>sum</p>")], "paper_id int, summary_html string")
    items = []
    for i in range(n):
        badge = "<b>［gap］</b> " if i % 4 == 0 else ""
        items.append(
            f"<li>{badge}“s&lt;{i}” <i>(p. 7 L 2)</i>" + ("" if i % 3 == 0 else "<br/>t&amp;amp;".replace("&amp;amp;", "&amp;")) + ("<br/><b>評論：</b>remark" if i % 5 == 0 else "") + "</li>"
        )
    want = "\n".join(["<h1>閱讀筆記</h1>", "<h2>一頁速覽</h2>", "<p>sum</p>", "<h2>我的劃線</h2><ul>", *items, "</ul>"])
    assert joined(K.note_html(heads, notes(spark, n)), "html", "part") == want


def test_terms_without_latin_letters(spark):
    terms = spark.createDataFrame([("潮汐",), ("tide, 潮位計 (gauge)",), ("42%",)], "term string")
    rows = [("1.1", 1, "a tidegauge 潮位"), ("1.2", 2, "談 潮汐 吧"), ("1.3", 3, "用潮位計量"), ("1.4", 4, "at 42% of them"), ("1.5", 5, "潮汐 again")]
    s = spark.createDataFrame([(1, *r, "para") for r in rows], "paper_id int, sid string, ord int, text string, kind string")
    got = {r.term: r.sid for r in first_occurrences(terms, s).collect()}
    assert got == {"潮汐": "1.2", "tide, 潮位計 (gauge)": "1.3", "42%": "1.4"}
    assert first_occurrences(terms, s.withColumn("text", F.lit("x潮汐x"))).count() == 0


def test_relevant_terms_equal_brute_force(spark):
    from quire.operators.glossary import relevant_terms

    glossary = [(1, "tide (潮汐)"), (1, "in (it)"), (1, "Ebb, slack"), (2, "tide (gauge)"), (2, "zz"), (2, None), (3, "a"), (9, "tide")]
    texts = [(1, 0, "The TIDE is in."), (1, 1, "潮汐 and it"), (1, 2, None), (2, 0, "tidegauge"), (2, 1, ""), (3, 0, "a"), (1, 3, "black slacks")]
    terms = spark.createDataFrame(glossary, "paper_id long, term string")
    batches = spark.createDataFrame(texts, "paper_id long, page int, text string")
    cuts = {t: [v.strip() for v in t.replace(")", "").replace(" (", ",").split(",") if len(v.strip()) > 1] for _, t in glossary if t}
    want = {
        (p, g, t) for p, g, x in texts for q, t in glossary if x and t and p == q and any(v.lower() in x.lower() for v in cuts[t])
    }
    got = relevant_terms(terms, batches, "paper_id", "page").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    shared = relevant_terms(terms.select("term").distinct(), batches, "paper_id", "page").collect()
    assert {(1, 0, "tide"), (2, 0, "tide"), (1, 3, "Ebb, slack"), (2, 0, "tide (gauge)")} <= {tuple(r) for r in shared}
    assert relevant_terms(terms.limit(0), batches, "paper_id", "page").count() == 0


def test_a_spelling_meets_on_its_rarest_pair(spark):
    """A common pair does not multiply candidates: 'thz' meets the one batch with 'hz', not all with 'th'."""
    from quire.operators.glossary import meetings, relevant_terms

    batches = spark.range(200).selectExpr("id page", "if(id = 7, 'the thz', 'the thin') text")
    terms = spark.createDataFrame([("thz",), ("thq",)], "term string")
    assert [tuple(r) for r in meetings(terms, batches, "page").collect()] == [(7, "thz", "thz")]
    assert [tuple(r) for r in relevant_terms(terms, batches, "page").collect()] == [(7, "thz")]


def test_glossaries_are_kept_apart(spark):
    terms = spark.createDataFrame([(1, "tide"), (2, "gauge")], "paper_id long, term string")
    rows = [(p, f"1.{n}", n, t, "para") for p in (1, 2) for n, t in ((1, "gauge here"), (2, "tide there"))]
    s = spark.createDataFrame(rows, "paper_id long, sid string, ord long, text string, kind string")
    assert {tuple(r) for r in first_occurrences(terms, s).collect()} == {(1, "tide", "1.2"), (2, "gauge", "1.1")}
