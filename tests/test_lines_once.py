"""A page's lines are made once, whatever is asked of them."""

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as Y
from quire.plans import load
from tests.test_layout import items, run
from tests.test_movement import DATA, unbroadcast  # noqa: F401


@pytest.mark.parametrize("name", ["L5_table_region", "L7_table_data_rows"])
def test_lines_are_made_once(unbroadcast, name):  # noqa: F811
    plan = load()[0][name](unbroadcast, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # Texts are read once, and no join brings lines to lines.
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_a_line_under_two_captions_is_one_cell(spark):
    rows = [("Table 1. A", 100.0), ("Table 2. B", 110.0), ("cell", 120.0), ("12.5", 120.0), ("body", 400.0)]
    d = [(1, 0, n, t, 54.0 + 40 * n, y, 90.0 + 40 * n, y + 10, y + 8, 8.0, "T", 10.0, "T", 2000.0) for n, (t, y) in enumerate(rows)]
    l = spark.createDataFrame(d, "paper_id int, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, base double, fs double, font string, body_fs double, body_font string, pw double")
    assert [r.line for r in Y.table_lines(l).orderBy("line").collect()] == [2, 3]
    assert [r.line for r in Y.data_rows(Y.table_cells(l)).collect()] == [2]
    pages = spark.createDataFrame([(1, 0, 2000.0)], "paper_id int, page int, w double")
    assert [r.line for r in Y.table_lines(l.drop("pw"), pages).orderBy("line").collect()] == [2, 3]


def test_runs_of_a_line_are_counted_without_its_characters(spark):
    odd = ["ab", "\t", "c ", " \t", "\r", "d", "\t"]
    i = items(spark, [run(0, n, t, 10 + 20 * n, 100, w=18) for n, t in enumerate(odd)] + [run(0, 10 + n, t, 10 + 20 * n, 200, w=18) for n, t in enumerate(["e", "f"])])
    got = Y.build_lines(i).select("line", "runs", F.length("text").alias("n"), "chars").collect()
    assert got and all(r.runs == len({c.item for c in r.chars if c.item >= 0}) and r.n == len(r.chars) for r in got)
    assert {r.line: r.runs for r in got}[2] == 2


def test_refit_reads_lines_not_runs(spark):
    """Texts are not read again for each join of its lines."""
    plan = load()[0]["L24_ink_refit"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan
