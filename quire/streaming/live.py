"""Structured Streaming form of replication: state, late data, bursts, idle sources, upsert sink, views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.replication import KEY, push
from quire.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet folder (or file pattern) as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def live_state(changes: DataFrame) -> DataFrame:
    """Continuous last-writer-wins state: one row per record, updated as changes arrive.

    The aggregate is the state: it keeps the winning version per key and nothing else.
    """
    rest = [c for c in changes.columns if c not in KEY]
    won = changes.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "rev")).alias("_w"))
    return won.select(*KEY, "_w.*")


def without_repeats(changes: DataFrame, event_time: str, overlap: str = "15 seconds") -> DataFrame:
    """Changes re-read through the cursor overlap appear once."""
    return changes.withWatermark(event_time, overlap).dropDuplicatesWithinWatermark([*KEY, "rev"])


def bursts(marks: DataFrame, event_time: str, gap: str, keys: list[str], lateness: str = "0 seconds") -> DataFrame:
    """Debounced marks: one row per burst of a key, closed when nothing came for ``gap``.

    In append mode a burst leaves once the watermark has passed its end, and its state with it;
    what is kept is the bursts still open.
    """
    g = marks.withWatermark(event_time, lateness).groupBy(*keys, F.session_window(event_time, gap).alias("s"))
    return g.agg(F.min(event_time).alias("first_at"), F.max(event_time).alias("last_at"), F.count("*").alias("marks")).drop("s")


def with_end(marks: DataFrame, event_time: str, last: DataFrame, gap: str) -> DataFrame:
    """A stream over finished input and one mark later than all of it, so that the last bursts close too.

    A stream that goes on needs none. ``last`` holds the input's latest ``event_time`` in one
    row; the added mark comes two gaps later, is null in all other columns and opens a burst
    that never closes. The input must be read in one batch, or later batches would be late.
    """
    spark = marks.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/end-{uuid.uuid4().hex}"
    late = F.coalesce(event_time, F.lit("1970-01-01").cast("timestamp")) + F.expr(f"2 * interval '{gap}'")
    last.select(*[late.alias(c) if c == event_time else F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in marks.columns]).write.parquet(path)
    return marks.unionByName(read_stream(spark, path, marks.schema))


def counts(events: DataFrame, *keys: str) -> DataFrame:
    """Continuously maintained counts and latest time per key."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


def idle_sources(lines: DataFrame, source: str, idle_ms: int = 90_000) -> DataFrame:
    """(source, lines, state): running line counts per source, and one ``timeout`` row when it goes silent."""
    schema = f"{source} string, lines bigint, state string"

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame({source: [key[0]], "lines": [seen], "state": ["timeout"]})
            return
        seen = state.get[0] if state.exists else 0
        seen += sum(len(p) for p in parts)
        state.update((seen,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({source: [key[0]], "lines": [seen], "state": ["open"]})

    return lines.groupBy(source).applyInPandasWithState(step, schema, "seen bigint", "append", "ProcessingTimeTimeout")


# ------------------------------------------------------------------ sinks ----


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert_sink(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = push, buckets: int = 64, key: str = "id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: merge a micro-batch into a bucketed Parquet table.

    Only buckets the batch touches are read and rewritten. The merged rows are staged
    first, so a failed write never loses the old ones, and since the merge is idempotent a
    replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = bucketed(batch, buckets, key)
        # At most ``buckets`` small integers reach the driver.
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            cols = [c for c in new.columns]
            old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*cols)
            merged = merge(old.drop("bucket"), batch.select(*[c for c in cols if c != "bucket"]))
        else:
            merged = merge(batch.limit(0), batch)
        stage = f"{path.rstrip('/')}_stage/{batch_id}-{uuid.uuid4().hex}"
        out = bucketed(merged.select(*batch.columns), buckets, key)
        out.write.parquet(stage)
        spark.read.parquet(stage).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all available input and return what it emitted, with its ``batch`` number.

    Output goes to files under the shared checkpoint folder, never through the driver.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/drain-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")


def final_rows(emitted: DataFrame, *keys: str) -> DataFrame:
    """Last emitted row per key of an update or complete stream."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")
