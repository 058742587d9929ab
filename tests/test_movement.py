"""What is made of a paper stays where the paper is: only its text is dealt out."""

import pytest
from pyspark.sql import functions as F

from quire.plans import load

DATA = "/root/testdata/sf0.001"


def shuffles(df):
    """Exchanges that Spark adds by itself, in the plan as it starts."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ENSURE_REQUIREMENTS" in line]


@pytest.fixture
def unbroadcast(spark):
    """No join gets by without a shuffle because its tables are small here."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize(
    "name",
    [
        "L24_ink_refit", "L6_line_position_label", "L5_table_region", "L2_line_assembly", "L3_line_text",
        "L16_piece_geometry", "L16_partial_runs", "L1_drop_cap_repair", "J10_point_in_rectangle", "T14_inverted_index_abstract", "T10_citation_rendering",
    ],
)
def test_only_texts_move(unbroadcast, name):
    assert shuffles(load()[0][name](unbroadcast, DATA)) == []


# Annotations and glossaries come to the papers: they move, but no word, piece or pair does.
# L7's cells are staged and dealt out again; its lines are not.
@pytest.mark.parametrize(("name", "kept"), [("L17_range_rectangles", "item#"), ("L7_table_data_rows", "line#"), ("T16_glossary_first_occurrence", "token#"), ("T17_glossary_relevance", "gram#")])
def test_other_tables_come_to_the_papers(unbroadcast, name, kept):
    moved = shuffles(load()[0][name](unbroadcast, DATA))
    assert not [line for line in moved if kept in line]


def test_pages_hold_the_runs(spark):
    """Rows per page hold the runs of ``text_items``, and lines are the same from either."""
    from quire.fixtures import Views
    from quire.operators import layout as Y

    v = Views(spark, DATA)
    names = ["paper_id", "page", "ix", "str", "x", "y", "w", "h", "base", "fs", "font"]
    flat, paged = v.text_items.select(names), v.page_items.selectExpr("paper_id", "page", "inline_outer(r)").select(names)
    assert flat.exceptAll(paged).isEmpty() and paged.exceptAll(flat).isEmpty()
    odd = spark.createDataFrame([(1, 0, i, s, 50.0 * i, 10.0, 20.0, 10.0, 18.0, 10.0, "T") for i, s in enumerate(["a", " ", "\t", "", None, "b"])], flat.schema)
    paged_odd = odd.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(F.struct(names[2:]))).alias("r"))
    for one, other in ((flat, v.page_items), (odd, paged_odd)):
        a, b = Y.build_lines(one).drop("chars"), Y.build_lines(other).drop("chars")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # A line of nothing but tabs is none.
    assert [r.text for r in Y.build_lines(odd).orderBy("line").collect()] == ["a", "b"]


def test_blocks_are_staged_without_characters(spark, monkeypatch):
    """Of the tables staged on the way to blocks without characters, none holds them."""
    from quire.operators import layout as Y

    staged, stage = [], Y.stage_table
    monkeypatch.setattr(Y, "stage_table", lambda df, name: (staged.append(df.columns), stage(df, name))[1])
    load()[0]["L8_block_assembly"](spark, DATA)
    assert staged and not [c for c in staged if "chars" in c]
