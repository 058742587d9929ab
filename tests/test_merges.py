"""Highlights over several ranges, merges of all machine output, restores over existing rows."""

from quire.operators.annotations import mirrored
from quire.operators.replication import merge_outputs
from quire.sources import backup as B

SENTENCES = [(1, "1.1", "alpha beta"), (1, "1.2", "gamma delta"), (1, "1.3", "end")]
TRANSLATIONS = [(1, "1.1", "甲乙"), (1, "1.2", "丙丁")]


def texts(spark, ranges):
    r = spark.createDataFrame(ranges, "id long, pos int, paper_id int, sid string, side string, s long, e long")
    s = spark.createDataFrame(SENTENCES, "paper_id int, sid string, text string")
    t = spark.createDataFrame(TRANSLATIONS, "paper_id int, sid string, t string")
    return {x.id: (x.sid, x.source_text, x.target_text) for x in mirrored(r, s, t).collect()}


def test_a_highlight_over_sentences_is_one_item(spark):
    got = texts(spark, [
        (1, 1, 1, "1.2", "src", 0, 5), (1, 0, 1, "1.1", "src", 6, 10),
        (2, 0, 1, "1.1", "tgt", 1, 2), (2, 1, 1, "1.2", "tgt", 0, 1),
        (3, 0, 1, "1.1", "src", 0, 5), (3, 1, 1, "1.2", "src", 0, 5), (3, 2, 1, "1.1", "src", 6, 10),
        (4, 0, 1, "1.3", "tgt", 0, 9), (5, 0, 1, "9.9", "src", 0, 9),
    ])
    assert got == {
        1: ("1.1", "beta gamma", "甲乙丙丁"),
        2: ("1.1", "alpha beta gamma delta", "乙丙"),
        3: ("1.1", "alpha gamma beta", "甲乙丙丁"),
        4: ("1.3", "end", ""),
        5: ("9.9", "", ""),
    }


def merged(spark, local, remote):
    schema = "paper_id int, epoch long, layer string, key string, value string, mock boolean"
    rows = merge_outputs(spark.createDataFrame(local, schema), spark.createDataFrame(remote, schema)).collect()
    assert len({(r.paper_id, r.layer, r.key) for r in rows}) == len(rows)
    return {(r.paper_id, r.layer + r.key): (r.value, r.origin) for r in rows}, {r.paper_id: r.push_back for r in rows}


def test_equal_epochs_fill_what_is_missing(spark):
    local = [(1, 5, "t", "1.1", "ours", False), (1, 5, "t", "1.2", "fake", True), (1, 5, "t", "1.3", "", False), (1, 5, "c", "1.1", "gap", False), (1, 5, "p", "0", "done", False)]
    remote = [(1, 5, "t", k, "theirs", False) for k in ("1.1", "1.2", "1.3", "1.4")]
    remote += [(1, 5, "c", "1.1", "method", False), (1, 5, "c", "1.2", "gap", False), (1, 5, "p", "0", "done", False), (1, 5, "p", "1", "done", False)]
    got, push = merged(spark, local, remote)
    assert push == {1: False}
    assert got == {
        (1, "t1.1"): ("ours", "local"), (1, "t1.2"): ("theirs", "remote"), (1, "t1.3"): ("theirs", "remote"), (1, "t1.4"): ("theirs", "remote"),
        (1, "c1.1"): ("gap", "local"), (1, "c1.2"): ("gap", "remote"), (1, "p0"): ("done", "local"), (1, "p1"): ("done", "remote"),
    }


def test_what_the_remote_lacks_is_pushed_back(spark):
    both = [(n, 1, "t", "1.1", "x", False) for n in (1, 2, 3, 4)]
    local = [*both, (1, 1, "c", "1.1", "gap", False), (2, 1, "p", "3", "done", False), (3, 1, "t", "1.2", "fake", True)]
    got, push = merged(spark, local, both)
    assert push == {1: True, 2: True, 3: False, 4: False}
    assert got[(3, "t1.2")] == ("fake", "local")


def test_epochs_decide_first(spark):
    local = [(1, 2, "t", "1.1", "ours", False), (2, 1, "t", "1.1", "ours", False), (2, 1, "c", "1.1", "gap", False), (3, 1, "t", "1.1", "ours", False)]
    remote = [(1, 1, "t", "1.1", "theirs", False), (1, 1, "p", "0", "done", False), (2, 2, "t", "1.1", "theirs", False), (3, 2, None, None, None, None), (4, 0, "c", "1.1", "gap", False)]
    got, push = merged(spark, local, remote)
    assert got == {(1, "t1.1"): ("ours", "local"), (2, "t1.1"): ("theirs", "remote"), (4, "c1.1"): ("gap", "remote")}
    assert push == {1: True, 2: False, 4: False}


def test_restore_replaces_rows_and_keeps_newer_ones(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, title string")
    now = spark.createDataFrame([(2, "renamed"), (3, "new")], "id int, title string")
    got = B.restore_table(B.dump_tables({"papers": old}), "papers", old.schema, ["id"], now)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None), (3, "new")]
