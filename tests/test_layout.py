"""Literal cases for layout, geometry and block operators."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import geometry as G
from quire.operators import layout as Y
from quire.plans import load

ITEM = "paper_id int, page int, ix int, str string, x double, y double, w double, h double, base double, fs double, font string"


def items(spark, rows, paper=1):
    return spark.createDataFrame([(paper, *r) for r in rows], ITEM)


def run(page, ix, text, x, base, fs=10.0, w=None, font="T"):
    return (page, ix, text, float(x), base - 0.8 * fs, float(w if w is not None else 5 * len(text)), fs, float(base), fs, font)


def article(spark):
    """Two pages, two columns: header, centred heading, hyphenated paragraph over columns and pages."""
    rows, ix = [], 0

    def put(page, text, x, base, **k):
        nonlocal ix
        rows.append(run(page, ix, text, x, base, **k))
        ix += 1

    for p in range(3):
        put(p, f"{518 + p}", 54, 40.0)
        put(p, "TIDES AND HARBOUR TRAFFIC", 200, 40.0)
    words = "Most gauges are calib-", "rated twice a year and their readings matter for", "harbour traffic which goes on over the column"
    put(0, "Reading the Gauges", 130, 100.0, font="B")
    for i, t in enumerate(words):
        put(0, t, 54, 130.0 + 12 * i, w=240)
    put(0, "and then it ends in the right column. A new one starts", 318, 130.0, w=240)
    put(0, "here and goes on to the next page without a stop", 318, 142.0, w=240)
    put(1, "where it finally ends after all. Done here with it now.", 54, 130.0, w=240)
    put(2, "This last page has a full paragraph of its own text too.", 54, 130.0, w=240)
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(3)], "paper_id int, page int, w double, h double")
    return items(spark, rows), pages


def test_lines_join_runs_and_add_blanks(spark):
    i = items(spark, [run(0, 0, "Hello", 10, 100), run(0, 1, "world", 40, 100), run(0, 2, "!", 65, 100), run(0, 3, "far", 300, 100), run(0, 4, "中", 10, 120), run(0, 5, "文", 18, 120, w=10)])
    lines = {r.line: r for r in Y.build_lines(i).collect()}
    assert [lines[k].text for k in sorted(lines)] == ["Hello world!", "far", "中文"]
    assert [(c.item, c.k) for c in lines[1].chars][5:7] == [(-1, -1), (1, 0)]


def test_drop_cap(spark):
    i = items(spark, [
        run(0, 0, "uriosity about tides and more text in this line", 60, 100), run(0, 1, "C early observers had. In their", 40, 112, fs=26.0, w=150),
        run(0, 2, "plain body text that sets the size of the page to ten", 40, 124),
    ])
    out = {r.ix: r for r in Y.fix_drop_caps(i).collect()}
    assert out[0].str.startswith("Curiosity") and out[0].x < 60
    assert out[1].str == "early observers had. In their" and out[1].fs <= 11.5
    assert out[2].str.startswith("plain")


def test_document_model(spark):
    i, pages = article(spark)
    m = Y.build_document(i, pages)
    sents = m["sentences"].orderBy("ord").collect()
    texts = [s.text for s in sents]
    assert "Reading the Gauges" in texts
    assert any("Most gauges are calibrated twice a year" in t for t in texts)
    assert not any("TIDES AND HARBOUR" in t for t in texts)
    over = next(s for s in sents if s.text.startswith("A new one starts"))
    assert over.text.endswith("ends after all.")
    assert {s.sid for s in sents if s.kind == "heading"}
    assert all(s.sid.split(".")[0] == str(s.page + 1) for s in sents)
    by_sid = {s.sid: s for s in sents}
    pieces = m["pieces"].collect()
    assert all(0 <= p.s < p.e <= len(by_sid[p.sid].text) for p in pieces)
    assert {p.page for p in pieces if p.sid == over.sid} == {0, 1}
    info = spark.createDataFrame([(1, "T")], "paper_id int, title string")
    row = Y.assemble_model(m["blocks"], m["sentences"], m["pieces"], info).first()
    assert len(row.order) == len(row.sentences) == len(sents) and len(row.pages) == 3
    for pg in row.pages:
        for b in pg.blocks:
            assert all(row.sentences[sid].block == b.id for sid in b.sids)


def test_page_numbers_by_vote(spark):
    rows = [(1, p, 0, t) for p, t in enumerate(["518", "519 Journal of X", "Vol 3 2003 520", "no number", "522-530"])]
    e = spark.createDataFrame(rows, "paper_id int, page int, n int, text string")
    pages = spark.createDataFrame([(1, 5)], "paper_id int, n_pages int")
    off, per = B.page_numbers(e, pages)
    assert off.first().page_offset == 518
    assert {r.page: r.printed for r in per.collect()} == {0: 518, 1: 519, 2: 520, 4: 522}


def test_outline_rules(spark):
    long_ = "This is a long paragraph that easily passes the limit of sixty characters in length."
    rows = [("title", "heading", "A Title Of The Paper", 20.0), ("p", "para", long_, 10.0), ("h", "heading", "Method", 12.0), ("p", "para", long_, 10.0),
            ("k", "heading", "Keywords: a, b", 12.0), ("p", "para", long_, 10.0), ("r", "heading", "References", 10.0), ("p", "para", long_, 10.0)]
    d = [(1, f"1.{i + 1}", i + 1, 0, k, t, fs, 10.0, False) for i, (_, k, t, fs) in enumerate(rows)]
    s = spark.createDataFrame(d, "paper_id int, sid string, ord int, page int, kind string, text string, fs double, body_fs double, centered boolean")
    assert {(r.sid, r.level) for r in B.outline(s).collect()} == {("1.3", 2), ("1.7", 1)}


def test_citation_hints(spark):
    lines = F.array(F.lit("Annals of Harbours Vol. 41 (June 1996), 12–33"), F.lit("© ISSN: 0022-2429 (print), 1547-7185 (electronic)"))
    heads = F.array(F.struct(F.lit(14.0).alias("fs"), F.lit(0).alias("i"), F.lit("Where Gauges Stand").alias("text")))
    null = F.lit(None).cast("string")
    h = spark.range(1).select(B.citation_hints(lines, heads, null, null, null, F.lit(None).cast("int")).alias("h")).first().h
    assert (h.volume, h.year, h.first_page) == ("41", 1996, "12")
    assert h.issn == ["0022-2429", "1547-7185"] and h.titles == ["Where Gauges Stand"]


def test_range_rects_merge_on_a_line(spark):
    p = spark.createDataFrame(
        [("ab cd ef", [(0, 2, 0, (0.0, 0.0, 10.0, 10.0)), (3, 5, 0, (13.0, 0.0, 23.0, 10.0)), (6, 8, 0, (0.0, 12.0, 10.0, 22.0))])],
        "text string, pieces array<struct<s:int,e:int,page:int,r:struct<x0:double,y0:double,x1:double,y1:double>>>",
    )
    r = p.select(G.range_rects(F.col("text"), F.col("pieces"), F.lit(0), F.lit(7), F.lit(0)).alias("r")).first().r
    assert len(r) == 2 and (r[0].x0, r[0].x1) == (0.0, 23.0) and 0 < r[1].x1 < 10


def test_figure_region_prefers_the_side_with_labels(spark):
    b = [(1, 0, 0, "para", 5, 10.0, 54.0, 100.0, 290.0, 200.0), (1, 0, 1, "label", 1, 8.0, 100.0, 250.0, 150.0, 260.0), (1, 0, 2, "caption", 1, 9.0, 54.0, 400.0, 280.0, 412.0), (1, 0, 3, "para", 9, 10.0, 54.0, 500.0, 290.0, 700.0)]
    d = spark.createDataFrame([(*r, 612.0, 792.0) for r in b], "paper_id int, page int, n int, kind string, n_lines int, fs double, x0 double, y0 double, x1 double, y1 double, w double, h double")
    r = G.figure_regions(d).first()
    assert (r.y0, r.y1) == (202.0, 414.0) and r.x1 == 306.0


def test_line_positions(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "para", 54.0, 70.0, 290.0, 130.0, 612.0), (1, 0, 1, "para", 318.0, 70.0, 560.0, 130.0, 612.0)], "paper_id int, page int, n int, kind string, x0 double, y0 double, x1 double, y1 double, w double")
    pc = [(1, f"1.{i + 1}", 0, 0, x, 72.0 + 12 * k, x + 100, 82.0 + 12 * k, 10.0) for i, (x, k) in enumerate([(54.0, 0), (54.0, 1), (318.0, 0), (318.0, 2)])]
    p = spark.createDataFrame(pc, "paper_id int, sid string, i int, page int, x0 double, y0 double, x1 double, y1 double, fs double")
    got = {r.sid: (r.col, r.line) for r in G.line_positions(p, blocks).collect()}
    assert got == {"1.1": ("L", 1), "1.2": ("L", 2), "1.3": ("R", 1), "1.4": ("R", 2)}
    lab = spark.range(1).select(G.line_label(F.lit("L"), F.lit(12)).alias("a"), G.line_label(F.lit("R"), F.lit(3), True).alias("b")).first()
    assert (lab.a, lab.b) == ("左欄第 12 行", "右欄 3 行")


def test_refit_only_touches_pages_that_miss(spark):
    rows = [(1, 0, k, f"s{k}", 0, 0, 50.0, 10.0 * k, 150.0, 10.0 * k + 8) for k in range(4)]
    p = spark.createDataFrame(rows, "paper_id int, page int, line int, sid string, i int, block int, x0 double, y0 double, x1 double, y1 double")
    ink = spark.createDataFrame([(1, 0, k, 60.0, 180.0) for k in range(4)], "paper_id int, page int, line int, a double, b double")
    bl = spark.createDataFrame([(1, 0, 0, 50.0, 0.0, 150.0, 38.0)], "paper_id int, page int, block int, x0 double, y0 double, x1 double, y1 double")
    out, boxes = G.refit(p, ink, bl)
    assert {(r.x0, round(r.x1, 6)) for r in out.collect()} == {(60.0, 180.0)} and boxes.first().x1 == 180.0
    fine = ink.withColumn("a", F.lit(50.0)).withColumn("b", F.lit(150.0))
    out, _ = G.refit(p, fine, bl)
    assert {r.fitted for r in out.collect()} == {False}


@pytest.mark.parametrize("name", ["L17_range_rectangles", "L16_piece_geometry", "L16_partial_runs", "L6_line_position_label"])
def test_pieces_are_neither_sorted_nor_joined(spark, name):
    """Characters and pieces are array elements of their sentence's row."""
    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and not re.search(r"Join .*\b(item|ix|pk)#", plan)


def test_runs_of_a_row_equal_runs_of_rows(spark):
    chars = [(0, 3), (0, 4), (-1, -1), (2, 0), (3, 0), (3, 1), (3, 3), (-1, -1)]
    rows = spark.createDataFrame([(1, 0, p, i, k) for p, (i, k) in enumerate(chars)], "paper_id int, page int, pos int, item long, k int")
    want = sorted((r.s, r.e, r.item, r.k0, r.k1) for r in Y.char_runs(rows, "paper_id").collect())
    code = F.when(F.col("item") >= 0, Y.char_code(F.col("item"), F.col("k"))).otherwise(-2)
    row = rows.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", code.alias("c")))), lambda x: x.c).alias("a"))
    assert [tuple(r) for r in row.select(F.inline(Y.runs_in(F.col("a")))).collect()] == want
