"""Papers without words, without text and of several rows, against DuckDB."""

import duckdb
import pytest

from quire.plans import load
from tests.oracle import compare

ROWS = [
    (1, "b a b\nc", "en", "s", 7), (2, "", "en", "s", 0), (3, " \n  ", "en", "s", 4), (4, None, "en", "s", None),
    (5, "x y", "en", "s", 3), (5, "x y x q y", "en", "s", 9), (None, "n n", "en", "s", 3),
]


@pytest.mark.parametrize("name", ["U2_order_preserving_distinct"])
def test_odd_papers_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    queries, oracles = load()
    ok, _, _, note = compare(spark, con, str(tmp_path), queries[name], oracles[name])
    assert ok, note
