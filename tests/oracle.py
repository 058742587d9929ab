"""Run registered queries next to their DuckDB twins and compare them.

    python -m tests.oracle [--sf DIR] [name-part ...] [-excluded-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.fixtures import BASE_TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6f}"
    return str(v)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    a = canon(df.columns, rows)
    if sql is None:
        return None, len(rows), t1 - t0, ""
    cur = con.execute(sql)
    b = canon([d[0] for d in cur.description], cur.fetchall())
    note = ""
    if a[0] != b[0]:
        note = f"columns {a[0]} != {b[0]}"
    elif a[1] != b[1]:
        sa, sb = set(a[1]), set(b[1])
        note = f"rows {len(a[1])} vs {len(b[1])}; spark-only {sorted(sa - sb)[:2]}; duck-only {sorted(sb - sa)[:2]}"
    return a == b, len(rows), t1 - t0, note


def main(argv):
    from quire.plans import load
    from quire.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    queries, oracles = load()
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    skip = [a[1:] for a in argv if a.startswith("-")]
    argv = [a for a in argv if not a.startswith("-")]
    for name, fn in queries.items():
        if (argv and not any(a in name for a in argv)) or any(a in name for a in skip):
            continue
        try:
            ok, n, sec, note = compare(spark, con, sf, fn, oracles.get(name))
            state = {True: "ok", False: "MISMATCH", None: "rows-only"}[ok]
        except Exception as e:  # noqa: BLE001
            state, n, sec, note = "ERROR", -1, 0.0, str(e)[:1200]
        if state in ("MISMATCH", "ERROR"):
            bad += 1
        print(f"{state:9} {name:44} rows={n:<7} {sec:6.2f}s {note[:1500]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
