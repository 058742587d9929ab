"""Queries R1-R3, R5, R7: streams over the event files, checked against their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.fixtures import Views
from quire.operators import ordering as O
from quire.operators import replication as R
from quire.plans.registry import query
from quire.session import ensure_checkpoint_dir
from quire.streaming import live as L

GAP_MS = 1_800_000


def event_stream(v: Views):
    """The events table as a stream, in the columns of the ``ev`` view plus the event time."""
    # A pattern, because a stream reads folders or patterns and not a single file.
    raw = L.read_stream(v.spark, f"{v.dir}/event[s].parquet", v.table("events").schema)
    return raw.select(
        "event_id", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"), F.col("ts").cast("timestamp").alias("ts")
    ).withColumn("ms", F.floor(F.unix_micros("ts") / 1000).cast("bigint"))


def change_stream(v: Views):
    return event_stream(v).select(
        "user_id", F.col("event_type").alias("tbl"), F.col("k").alias("id"), F.col("value").alias("data"),
        (F.floor(F.col("ms") / 3_600_000) * 3_600_000).cast("bigint").alias("updated_at"), F.col("event_id").alias("rev"), (F.col("event_id") % 13 == 0).alias("deleted"),
    )


LATEST = """select user_id, tbl, id, "data", updated_at, rev, deleted from changes_v qualify row_number() over (partition by user_id, tbl, id order by updated_at desc, rev desc)=1"""


@query("R1_continuous_lww_state", LATEST)
def r1(v: Views):
    return L.final_rows(L.drain(L.live_state(change_stream(v)), "update", "lww"), *R.KEY)


@query("R2_late_data_without_repeats", "select user_id, tbl, id, rev from changes_v")
def r2(v: Views):
    # Every change arrives twice, as it does through an overlapping cursor.
    s = event_stream(v).select("user_id", F.col("event_type").alias("tbl"), F.col("k").alias("id"), F.col("event_id").alias("rev"), "ts")
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return L.drain(L.without_repeats(twice, "ts"), "append", "late").select("user_id", "tbl", "id", "rev")


SESSIONS = f"""with m as (select user_id, event_type tbl, ms, case when ms - lag(ms) over (partition by user_id, event_type order by ms) >= {GAP_MS} or lag(ms) over (partition by user_id, event_type order by ms) is null then 1 else 0 end brk from ev_v),
 s as (select *, sum(brk) over (partition by user_id, tbl order by ms rows between unbounded preceding and current row) run from m)
 select user_id, tbl, min(ms) first_at, max(ms) last_at, count(*) marks from s group by user_id, tbl, run"""


@query("R3_debounce_bursts", SESSIONS)
def r3(v: Views):
    marks = v.ev.select("user_id", F.col("event_type").alias("tbl"), "ms")
    return O.sessions(marks, ["user_id", "tbl"], "ms", GAP_MS)


@query("R3_debounce_stream", SESSIONS)
def r3s(v: Views):
    s = event_stream(v).select("user_id", F.col("event_type").alias("tbl"), "ts")
    ended = L.with_end(s, "ts", v.table("events").agg(F.max("ts").cast("timestamp").alias("ts")), "30 minutes")
    out = L.drain(L.bursts(ended, "ts", "30 minutes", ["user_id", "tbl"]), "append", "bursts")
    ms = lambda c: F.floor(F.unix_micros(c) / 1000).cast("bigint")
    return out.select("user_id", "tbl", ms("first_at").alias("first_at"), ms("last_at").alias("last_at"), "marks")


@query("R5_micro_batched_upsert", LATEST)
def r5(v: Views):
    base = f"{ensure_checkpoint_dir(v.spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    state = change_stream(v)

    def merge(old, batch):
        return R.push(R.latest(old), R.latest(batch)).drop("applied")

    q = (
        state.writeStream.foreachBatch(L.upsert_sink(f"{base}/table", merge))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return v.spark.read.parquet(f"{base}/table").drop("bucket")


@query("R7_maintained_views", "select user_id, event_type, count(*) n, max(ms) last_ms from ev_v group by all")
def r7(v: Views):
    return L.final_rows(L.drain(L.counts(event_stream(v), "user_id", "event_type"), "complete", "views"), "user_id", "event_type")
