"""Flagship: lines stay where their document is; only what may be a running line is moved."""

from quire.fixtures import Views
from quire.plans import load
from tests.test_movement import DATA, shuffles, unbroadcast  # noqa: F401


def test_lines_stay_with_their_document(unbroadcast):  # noqa: F811
    moved = shuffles(load()[0]["flagship_clean_sentences"](unbroadcast, DATA))
    assert not [x for x in moved if "line_no#" in x or "doc#" in x] and len(moved) <= 7


def test_last_line_of_a_document(spark):
    v = Views(spark, DATA)
    v.documents = spark.createDataFrame([(1, "a\n\n b \n \n", "s", "en"), (2, "", "s", "en"), (3, None, "s", "en"), (4, "x", "t", "en")], "doc_id long, text string, source string, lang string")
    got = [tuple(r) for r in v.lines_to_last.orderBy("paper_id", "line_no").collect()]
    assert got == [(1, "s", 0, "a", 2), (1, "s", 2, "b", 2), (4, "t", 0, "x", 0)]
    assert v.lines_to_last.drop("last_line").exceptAll(v.lines.drop("lang")).isEmpty()
