"""Work that must not multiply as the tables grow."""

import os

from quire.plans import load

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, _ = load()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_matrix_is_not_made_again_per_element(spark):
    """Elements of a made matrix are read as what they are, so the filter builds no array per element."""
    filters = [x for x in optimized(QUERIES["S1_normalise_runs"](spark, SF)).splitlines() if "Filter" in x]
    assert filters and not any("array(" in x for x in filters)


def test_an_own_glossary_is_read_in_place(spark):
    """No row per spelling or character pair; what is found is the only thing made into rows."""
    from quire.operators.glossary import glossaries, relevant_terms

    terms = spark.range(50).selectExpr("id % 5 paper_id", "concat('tide', id, ' (ebb', id, ')') term")
    batches = spark.range(40).selectExpr("id % 5 paper_id", "id page", "concat('the tide', id, ' and EBB', id + 5) text")
    got = relevant_terms(glossaries(terms, "paper_id"), batches, "paper_id", "page")
    text = {p: f"the tide{p} and ebb{p + 5}" for p in range(40)}
    want = {(p % 5, p, f"tide{i} (ebb{i})") for p in text for i in range(50) if i % 5 == p % 5 and (f"tide{i}" in text[p] or f"ebb{i}" in text[p])}
    assert {tuple(r) for r in got.collect()} == want
    assert "gram" not in optimized(relevant_terms(terms, batches, "paper_id", "page"))


def test_drop_caps_are_mended_within_the_page(spark):
    """L1: a page's runs are one array, so they are neither joined nor sorted, and pages and rows give the same runs."""
    from pyspark.sql import functions as F

    from quire.fixtures import Views
    from quire.operators import layout as Y
    from quire.plans.layout import drop_cap_pages

    assert "Join" not in optimized(QUERIES["L1_drop_cap_repair"](spark, SF))
    pages = drop_cap_pages(Views(spark, SF))
    rows = pages.select("paper_id", "page", F.explode("r").alias("r")).select("paper_id", "page", "r.*")
    want = Y.fix_drop_caps(pages).select("paper_id", "page", F.explode("r").alias("r")).select("paper_id", "page", "r.*")
    got = Y.fix_drop_caps(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    changed = want.join(rows.withColumnRenamed("str", "was"), ["paper_id", "page", "ix"]).where("str <> was")
    assert changed.count() > 0


def test_an_index_is_made_within_its_paper(spark):
    """Words are neither grouped nor collected over rows."""
    assert "Aggregate" not in optimized(QUERIES["T14_inverted_index_abstract"](spark, SF))


def test_an_answer_is_cleaned_once(spark):
    """The cleaning of an answer stands once in the plan, not in each filter on its result."""
    from pyspark.sql import functions as F

    from quire.operators.model_apply import accepted

    rows = spark.createDataFrame([(1, "1.1", "Tides rise in the harbour."), (1, "1.2", "ﬁne Tides")], "paper_id int, sid string, text string")
    # The answers: an echo with its translation, and an echo that ends in a ligature.
    answers = rows.withColumn("text", F.concat("text", F.lit(" 潮汐。")))
    got = accepted(answers, rows, F.lit("中文"), False)
    assert optimized(got).count("regexp_instr(") == 1
    assert {r.sid: r.t for r in got.collect()} == {"1.1": "潮汐。", "1.2": "潮汐。"}
