"""Sources, sinks, replication and streaming on small data."""

import time
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import importing as I
from quire.operators import linkage as K
from quire.operators import model_apply as P
from quire.operators import ordering as O
from quire.operators import replication as R
from quire.plans import load
from quire.sources import backup as BK
from quire.sources import records as N
from quire.sources import replace_sets as RS
from quire.sources import sinks as X
from quire.streaming import live as L


def test_lenient_json_and_filters(spark):
    a = spark.createDataFrame([(1, '```json\n{"questions":[{"q":"a","options":["x","y"],"answer":1},{"q":"b","options":["x"],"answer":0},{"q":"c","options":["x","y"],"answer":2}]}\n```'), (2, 'Well: {"questions":[]} ok')], "paper_id int, answer string")
    got = {r.paper_id: [q.q for q in r.questions] for r in N.clean_quiz(a).collect()}
    assert got == {1: ["a"], 2: []}


def test_line_records(spark):
    d = spark.createDataFrame([("1.2\tText",), (" 1.3 | a b ",), ("1.4｜中",), ("1.5: x",), ("nothing",), ("1.6 - no",)], "value string")
    assert [(r.sid, r.text) for r in N.parse_lines(d).collect()] == [("1.2", "Text"), ("1.3", "a b"), ("1.4", "中"), ("1.5", "x")]


def test_manager_and_registry_items(spark):
    m = spark.createDataFrame([('{"key":"K","title":"","creators":[{"creatorType":"author","name":"WHO"},{"creatorType":"translator","lastName":"Z"}],"date":"May 1999","ISSN":"1, 2","pages":"3 – 9","DOI":"https://doi.org/10.1/A"}',)], "j string")
    r = N.parse_works(m, "j", "manager").first()
    assert (r.title, r.year, r.issn, r.first_page, r.last_page, r.doi) == ("（未命名）", 1999, ["1", "2"], "3", "9", "10.1/a")
    assert [a.family for a in r.authors] == ["WHO"]


def test_backup_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id int, title string, rating int")
    BK.write_backup({"papers": papers}, str(tmp_path))
    back = BK.read_backup(spark, str(tmp_path), {"papers": papers.schema})["papers"]
    assert sorted(map(tuple, back.collect())) == [(1, "a", None), (2, "b", 3)]


def test_ris_parts_hold_every_note(spark):
    heads = spark.createDataFrame([(1, "TY  - JOUR\r\n"), (2, "TY  - JOUR\r\n")], "paper_id int, head string")
    notes = spark.range(1203).selectExpr("1 paper_id", "0 page", "id created_at", "id", "concat('n', id) line")
    parts = X.to_ris(heads, notes).orderBy("paper_id", "part").collect()
    mine = [p.ris for p in parts if p.paper_id == 1]
    assert len(mine) == 5 and mine[-1] == "ER  - \r\n" and mine[1].startswith("N1  - Highlights<br>n0<br>")
    assert sum(t.count("n") for t in mine[1:-1]) == 1203
    assert [p.ris for p in parts if p.paper_id == 2] == ["TY  - JOUR\r\n", "ER  - \r\n"]


def test_bucketed_rank_equals_window_on_a_hot_key(spark):
    d = spark.range(5000).selectExpr("case when id % 3 = 0 then 0 else id % 7 end u", "id * 13 % 5003 t")
    got = O.bucketed_row_number(d, ["u"], F.floor(F.col("t") / 100), ["t"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.u, r.t)):
        by[r.u] = by.get(r.u, 0) + 1
        assert r.rn == by[r.u]


def test_lww_ties(spark):
    cols = "user_id int, tbl string, id int, data string, deleted boolean, updated_at long, rev long"
    old = spark.createDataFrame([(1, "t", 1, "old", False, 10, 1), (1, "t", 2, "new", False, 20, 2)], cols)
    inc = spark.createDataFrame([(1, "t", 1, "tie", False, 10, 3), (1, "t", 2, "late", False, 5, 4)], cols)
    assert {(r.id, r.data, r.applied) for r in R.push(old, inc).collect()} == {(1, "tie", True), (2, "new", False)}
    assert {(r.id, r.data) for r in R.apply_remote(old, inc).collect()} == {(1, "old"), (2, "new")}


def test_title_join_is_exact(spark):
    names = [f"{a} {b} {n}" for a in ("small", "large", "smart") for b in ("ring", "ringlet", "gear") for n in range(9)]
    left = spark.createDataFrame([(i, t + (" x" if i % 2 else "")) for i, t in enumerate(names)], "id long, title string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(names[::2])], "id long, title string")

    def dice(a, b):
        from collections import Counter

        x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
        return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))

    for t in (0.75, 0.9):
        want = {}
        for i, a in left.collect():
            best = max(((dice(a, b), -j) for j, b in right.collect()), default=(0, 0))
            if best[0] >= t:
                want[i] = -best[1]
        assert {r.id: r.work for r in K.best_titles(left, right, t).collect()} == want


def test_journal_match_prefers_issn_then_name(spark):
    j = spark.createDataFrame([("Journal of A & B", ["1111-111x"], 1, 1), ("Other", [], 2, 2)], "name string, issn array<string>, ord int, tier int")
    w = spark.createDataFrame([(1, "none", ["1111-111X"]), (2, "The Journal of A and B", None), (3, "x", None)], "id int, journal string, issn array<string>")
    assert {r.id: r.matched for r in K.match_journals(w, j).collect()} == {1: "Journal of A & B", 2: "Journal of A & B", 3: None}


def test_retry_rounds_and_echo(spark):
    req = spark.createDataFrame([(1, "1.1", "This is a plain English sentence."), (1, "1.2", "H1")], "paper_id int, sid string, text string")

    def ask(missing, r):
        return missing.select("paper_id", "sid", "text")  # always copies the source

    got = {r.sid: r["round"] for r in P.ask_in_rounds(req, ask, F.lit("中文")).collect()}
    assert got == {"1.1": 1, "1.2": 0}


def test_saved_works_link_and_dois(spark):
    saved = spark.createDataFrame([("a", "10.1/A", None)], "id string, doi string, paper_id string")
    done = spark.createDataFrame([("10.1/a", "p1")], "doi string, paper_id string")
    assert I.link_saved(saved, done).first().paper_id == "p1"


def test_stream_state_equals_batch_over_many_files(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "user_id", "event_type tbl", "event_id % 50 id", "value data", "false deleted", "cast(event_id % 97 as bigint) updated_at", "event_id rev"
    )
    src.repartition(6).write.parquet(str(tmp_path / "in"))
    s = L.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    live = L.final_rows(L.drain(L.live_state(s), "update", "t"), *R.KEY)
    assert sorted(map(str, live.select(*src.columns).collect())) == sorted(map(str, R.latest(src).select(*src.columns).collect()))
    q = (
        L.read_stream(spark, str(tmp_path / "in"), src.schema, 1).writeStream
        .foreachBatch(L.upsert_sink(str(tmp_path / "table"), lambda o, b: R.push(R.latest(o), R.latest(b)).drop("applied"), 4))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table")).select(*src.columns)
    assert sorted(map(str, table.collect())) == sorted(map(str, R.latest(src).select(*src.columns).collect()))


def test_idle_source_times_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pd.DataFrame({"source": ["a", "a"], "line": ["x", "y"]}).to_parquet(tmp_path / "in" / "1.parquet")
    s = L.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = L.idle_sources(s, "source", 500).writeStream.format("memory").queryName("idle_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            states = [(r.lines, r.state) for r in spark.table("idle_out").collect()]
            if (2, "timeout") in states:
                break
            time.sleep(0.3)
        assert (2, "open") in states and (2, "timeout") in states
    finally:
        q.stop()


REGISTRY = "id long, doi string, issn array<string>, first_page long, yr int, volume string, title string"
HINTS = "id long, doi string, issn array<string>, first_page long, yr int, volume string, titles array<string>"


def test_cascade_tries_three_titles_and_the_first_page(spark):
    first = spark.createDataFrame([(1, "10.1/a", ["i1"], 5, 2001, None, "gauges of the northern harbours"), (2, None, ["i1"], 9, 2002, None, "the third title of them all")], REGISTRY)
    second = spark.createDataFrame([
        (50, None, ["i1"], 7, 2003, None, "a record of the other registry"), (51, None, ["i1"], 8, 2003, None, "a record of the other registry"),
        (52, None, ["i2"], 7, 2003, None, "a record of the other registry"), (53, None, ["i9"], 4, 2009, None, "something with no title asked"),
    ], REGISTRY)
    none, yr = None, 2003
    hints = spark.createDataFrame([
        (1, "10.1/A", none, none, none, none, ["x"]), (2, none, ["i1"], 9, 2002, none, none),
        (3, none, none, none, none, none, ["running heading here", "another running heading", "the third title of them all"]),
        # The title that would be found is the fourth that is long enough, or too short.
        (4, none, none, none, none, none, ["running heading aa", "running heading bb", "running heading cc", "the third title of them all"]),
        (5, none, none, none, none, none, ["short", "short", "running heading aa", "running heading bb", "the third title of them all"]),
        (6, none, ["i1", "i2"], none, yr, none, ["a record of the other registry"]), (7, none, ["i1"], 8, yr, none, ["a record of the other registry"]),
        (8, none, ["i1"], 99, yr, none, ["a record of the other registry"]), (9, none, ["i2"], none, yr, none, ["a record of the other registry"]),
        (10, none, ["i9"], 4, 2009, none, []), (11, none, ["i9"], 5, 2009, none, none), (12, none, ["i9"], none, 2009, none, ["tiny"]),
    ], HINTS)
    got = {r.id: (r.work, r.via) for r in K.link(hints, first, second).collect()}
    assert got == {
        1: (1, "doi"), 2: (2, "biblio"), 3: (2, "title"), 4: (-1, "none"), 5: (2, "title"), 6: (50, "second"), 7: (51, "second"),
        8: (50, "second"), 9: (52, "second"), 10: (53, "second"), 11: (-1, "none"), 12: (-1, "none"),
    }


def test_title_search_meets_few(spark):
    """A common word leads nowhere, however many titles hold it; runs of common words do."""
    many = spark.createDataFrame([(i, f"tidal gauges number {i} of harbour {i % 7}") for i in range(500)], "id long, title string")
    asked = spark.createDataFrame([(1, "tidal gauges number 77 of harbour 0"), (2, "tidal gauges"), (3, "")], "id long, title string")
    assert [(r.id, r.work, r.dice) for r in K.best_titles(asked, many, 0.75).collect()] == [(1, 77, 1.0)]
    found = K.search_titles(spark.createDataFrame([("tidal gauges number 77 of harbour 0",)], "key string"), K._registry_keys(many)).collect()
    assert len(found) <= K.CANDIDATES


def test_replace_sets_on_files(spark, tmp_path):
    path, cols = str(tmp_path / "sets"), "paper_id long, sid string, c string"
    frame = lambda rows: spark.createDataFrame(rows, cols)
    RS.create(frame([(1, "1.1", "a"), (1, "1.2", "a"), (2, "1.1", "a"), (3, "1.1", "a"), (None, "1.1", "a")]), path, buckets=2, files=2)
    valid = spark.createDataFrame([(p, "1.1") for p in (1, 2, 3, 4)], "paper_id long, sid string")
    # Paper 2 has only an invalid row, so it loses its set; a null paper owns nothing; 4 is new.
    new = frame([(1, "1.1", "b"), (1, "9.9", "b"), (2, "9.9", "b"), (4, "1.1", "b"), (None, "1.1", "b")])
    for _ in range(2):  # a repeated write changes nothing
        RS.replace(path, new, valid, buckets=2, files=2)
        got = sorted(tuple(r) for r in RS.read(spark, path).select("paper_id", "sid", "c").collect())
        assert got == [(1, "1.1", "b"), (3, "1.1", "a"), (4, "1.1", "b")]
    # All sets of every bucket emptied: the old files do not stay.
    RS.replace(path, frame([(p, "9.9", "x") for p in (1, 3, 4)]), valid, buckets=2)
    assert RS.read(spark, path).count() == 0
    RS.replace(path, frame([]), valid, buckets=2)
    assert RS.read(spark, path).count() == 0


def test_replace_leaves_other_buckets_alone(spark, tmp_path):
    path = tmp_path / "many"
    RS.create(spark.range(200).selectExpr("id paper_id", "'1.1' sid", "'old' c"), str(path), buckets=8)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in path.glob("_bucket=*/*.parquet")}
    before = files()
    RS.clear_column(str(path), spark.range(1).selectExpr("id paper_id"), "c", buckets=8)
    after = files()
    assert sum(before[f] == after.get(f) for f in before) == 7
    assert [tuple(r) for r in RS.read(spark, str(path)).where("c is null").collect()] == [(0, "1.1", None)]
    assert RS.read(spark, str(path)).count() == 200


def test_tree_paths_and_cycles(spark):
    import pytest

    from quire.operators.graph import tree_paths

    nodes = lambda rows: spark.createDataFrame(rows, "k string, parent string, name string")
    chain = [("n0", None, "x")] + [(f"n{i}", f"n{i - 1}", "x") for i in range(1, 65)]
    got = {r.k: (r.depth, r.path) for r in tree_paths(nodes(chain + [("lost", "gone", "x"), ("a", "b", "x"), ("b", "a", "x")])).collect()}
    assert len(got) == 65 and got["n64"][0] == 64 and got["n2"] == (2, "n0/n1/n2")
    assert tree_paths(nodes([])).count() == 0
    with pytest.raises(Exception, match="deeper than 64"):
        tree_paths(nodes([*chain, ("n65", "n64", "x")])).collect()
    with pytest.raises(Exception, match="or a cycle"):
        tree_paths(nodes([("r", None, "x"), ("c", "r", "x"), ("d", "c", "x"), ("c", "d", "x")])).collect()


def test_neighbours_are_ordered_by_first_author(spark):
    from quire.operators.graph import neighbours

    works = spark.createDataFrame(
        [(1, 5, "Ob"), (2, 1, "éa"), (3, 2, "Zo"), (4, 9, None), (5, 0, "ea"), (6, 0, "Ea"), (7, 0, "ob")], "id long, cited_by long, family string"
    )
    edges = spark.createDataFrame([(9, i) for i in range(1, 8)] + [(3, 9), (4, 9)], "src long, dst long")
    got = neighbours(edges, works).where("seed = 9").collect()
    assert [r.work for r in sorted(got, key=lambda r: r["rank"]) if r.direction == "reference"] == [4, 5, 6, 2, 7, 1, 3]
    assert [r.work for r in sorted(got, key=lambda r: r["rank"]) if r.direction == "cited_by"] == [4, 3]
    cut = neighbours(edges, works, max_refs=3, max_citing=1).where("seed = 9").collect()
    assert {(r.direction, r["rank"], r.work) for r in cut} == {("reference", 1, 2), ("reference", 2, 1), ("reference", 3, 3), ("cited_by", 1, 4)}


def test_closed_bursts_leave_no_state(spark, tmp_path):
    marks = spark.range(3000).selectExpr("id % 7 user_id", "timestamp_seconds(id * 600) ts")
    marks.write.parquet(str(tmp_path / "in"))
    s = L.read_stream(spark, str(tmp_path / "in"), marks.schema)
    ended = L.with_end(s, "ts", marks.agg(F.max("ts").alias("ts")), "30 minutes")
    rows = []
    q = (
        L.bursts(ended, "ts", "30 minutes", ["user_id"]).writeStream.outputMode("append")
        .foreachBatch(lambda b, _: rows.extend(b.collect()))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    # A mark every 70 minutes per key: each is a burst of its own; the end mark alone stays open.
    assert len(rows) == 3000 and sum(r.marks for r in rows) == 3000
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_reference_faults(spark):
    from quire.operators.annotations import reference_faults

    s = spark.createDataFrame([(1, "1.1", "b1", "abcde"), (1, "1.2", "b2", "")], "paper_id long, sid string, block string, text string")
    refs = [
        (1, "1.1", "b1", 0, 5, "x"), (1, "1.1", "b1", 0, 5, "x"), (1, "1.1", "b1", 0, 6, "x"), (1, "1.1", "b9", 2, 2, "x"),
        (1, "1.1", None, -1, 2, "x"), (1, "1.2", "b2", 0, 1, "x"), (1, "7.7", "b1", 0, 1, "x"), (None, None, None, None, None, "x"),
        (1, "1.1", "b1", None, 3, "y"),
    ]
    refs = spark.createDataFrame(refs, "paper_id long, sid string, block string, s int, e int, kind string")
    got = {r.kind: tuple(r)[1:] for r in reference_faults(refs, s, "kind").collect()}
    assert got == {"x": (8, 2, 4, 4), "y": (1, 0, 1, 0)}
    assert reference_faults(refs.limit(0), s, "kind").count() == 0


def test_a_title_without_a_rare_run_is_found(spark):
    """No run of words leads to the most similar title, or better ones share none: every pair counts."""
    many = spark.createDataFrame([(i, f"tidal gauges number {i} of harbour {i % 7}") for i in range(60)], "id long, title string")
    asked = spark.createDataFrame([(1, "tidall gaugess numbers 777 off harbours 8"), (2, "gauges tidal number 60 of harbour 9"), (3, "x")], "id long, title string")

    def dice(a, b):
        x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
        return 2.0 * (x & y).total() / (len(a) + len(b) - 2)

    best = {q.id: max((dice(q.title, r.title), -r.id) for r in many.collect()) for q in asked.collect()}
    want = {k: (-w, d) for k, (d, w) in best.items() if d >= 0.75}
    assert set(want) == {1, 2}
    assert {r.id: (r.work, r.dice) for r in K.best_titles(asked, many, 0.75).collect()} == want


def test_cascade_never_passes_its_tables_through_the_driver(spark):
    plan = load()[0]["J1_linkage_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
