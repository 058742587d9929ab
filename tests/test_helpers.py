"""Readers and small operators that no registered query uses."""

import json

from pyspark.sql import functions as F

from quire.operators import importing as I
from quire.operators import joins as J
from quire.operators import replication as R
from quire.sources import backup as B
from quire.sources import records as N


def test_read_works_of_all_shapes(spark, tmp_path):
    rows = {
        "index": {"id": "https://openalex.example/W1", "doi": "https://doi.org/10.1/A", "display_name": "Tides", "publication_year": 1996, "cited_by_count": 3},
        "registry": {"DOI": "10.1/B", "title": ["Quays"], "author": [{"given": "Ada", "family": "Bo"}], "page": "12-33", "issued": {"date-parts": [[1997]]}},
        "manager": {"key": "K1", "title": "Locks", "creators": [{"creatorType": "author", "name": "Cy"}], "date": "June 1998", "pages": "7–9"},
    }
    for name, row in rows.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(row))
    got = {r["shape"]: r for r in N.read_works(spark, {n: str(tmp_path / n) for n in rows}).collect()}
    assert [(got[n].title, got[n].year) for n in rows] == [("Tides", 1996), ("Quays", 1997), ("Locks", 1998)]
    assert (got["registry"].first_page, got["manager"].last_page, got["index"].doi) == ("12", "9", "10.1/a")


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.1\tfirst\nchatter\n1.2 | second\n")
    got = N.parse_lines(N.read_lines(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, got)) == [("1.1", "first"), ("1.2", "second")]
    assert N.read_lines(spark, str(tmp_path), streaming=True).isStreaming


def test_tombstones_and_pages(spark):
    rec = spark.createDataFrame([("u", "t", k, 10, False) for k in range(6)], "user_id string, tbl string, id int, updated_at int, deleted boolean")
    gone = R.tombstone(rec, rec.where("id = 3"), F.lit(99)).where("deleted").collect()
    assert [(r.id, r.updated_at) for r in gone] == [(3, 99)]
    assert [r.id for r in R.next_page(rec, "id", 1, 3).collect()] == [2, 3, 4]


def test_invalidated_papers(spark):
    over = spark.createDataFrame([(1, True), (2, False)], "id int, identity_changed boolean")
    assert [r.paper_id for r in I.invalidate(spark.createDataFrame([(1,), (2,), (3,)], "paper_id int"), over).orderBy("paper_id").collect()] == [2, 3]


def test_restore_over_existing_rows(spark):
    """A dumped row replaces the current one; of two with one key the same wins whatever the order."""
    current = spark.createDataFrame([(1, "old"), (2, "kept")], "id int, v string")
    for order in (1, -1):
        rows = spark.createDataFrame([(1, "a"), (1, "b"), (3, "new")][::order], "id int, v string")
        back = B.restore_table(B.dump_tables({"notes": rows}), "notes", rows.schema, ["id"], current)
        assert sorted(map(tuple, back.collect())) == [(1, "b"), (2, "kept"), (3, "new")]


def test_rows_without_a_key_join_nothing(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 11)], "k string, w int")
    got = J.left_join(left, right, ["k"], ["id"]).orderBy("id").collect()
    assert [(r.id, r.k, r.w) for r in got] == [(1, "a", 10), (2, None, None), (3, None, None), (4, "z", None)]
