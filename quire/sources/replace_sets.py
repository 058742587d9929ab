"""A table of sets per paper on files: a paper's set is replaced as a whole, in place.

The table is Parquet, partitioned by a hash bucket of ``paper_id``; choose ``buckets`` so that
one is a few hundred megabytes. A write reads and rewrites the buckets of the papers it
replaces and no other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.replication import replace_rows
from quire.session import ensure_checkpoint_dir


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, files: int) -> None:
    # A bucket is ``files`` tasks and files; a paper's rows may lie in several of them.
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    out = rows.repartition("_bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("_bucket").parquet(path)


def create(rows: DataFrame, path: str, buckets: int = 64, files: int = 1) -> None:
    """Write a new table. Rows without a paper belong to no set and are left out."""
    _write(rows.where("paper_id is not null").withColumn("_bucket", _bucket(buckets)), path, files)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).where("paper_id is not null").drop("_bucket")


def _rewrite(spark: SparkSession, path: str, papers: DataFrame, change: Callable[[DataFrame], DataFrame], buckets: int, files: int) -> None:
    """Replace the buckets of ``papers`` by ``change`` of their rows.

    The new rows are staged before the first old file goes, and a bucket is replaced by Spark's
    commit of its partition. A run that was lost half way is mended by running it again, as both
    changes below give the same rows when repeated.
    """
    # At most ``buckets`` small integers reach the driver; they prune the partitions read.
    touched = [r[0] for r in papers.select(_bucket(buckets)).distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
    new = change(old.where("paper_id is not null").drop("_bucket")).withColumn("_bucket", _bucket(buckets))
    # An empty partition would not be overwritten: every bucket holds one row of no paper.
    marks = spark.createDataFrame([(b,) for b in touched], "_bucket int")
    stage = f"{ensure_checkpoint_dir(spark).rstrip('/')}/replace-{uuid.uuid4().hex}"
    new.unionByName(marks, allowMissingColumns=True).write.parquet(stage)
    _write(spark.read.parquet(stage), path, files)


def replace(path: str, new: DataFrame, valid: DataFrame, buckets: int = 64, files: int = 1) -> None:
    """Each paper of ``new`` gives up all its rows for its new ones whose (paper_id, sid) is in ``valid``.

    A paper all of whose new rows are invalid keeps none. Rows without a paper are left out.
    ``buckets`` is the table's own number.
    """
    given = new.where("paper_id is not null")
    _rewrite(new.sparkSession, path, given.select("paper_id"), lambda old: replace_rows(old, given, valid), buckets, files)


def clear_column(path: str, papers: DataFrame, column: str, buckets: int = 64, files: int = 1) -> None:
    """Set ``column`` to null for ``papers`` (paper_id), e.g. the legacy form of a set that was replaced."""
    gone = papers.select("paper_id").where("paper_id is not null").distinct().withColumn("_gone", F.lit(True))

    def change(old: DataFrame) -> DataFrame:
        kept = F.when(F.col("_gone").isNull(), F.col(column))
        return old.join(gone, "paper_id", "left").withColumn(column, kept).select(*old.columns)

    _rewrite(papers.sparkSession, path, gone, change, buckets, files)
