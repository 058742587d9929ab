"""Backup and restore of the record tables: one row per record, tagged with its table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

APP = "quire"
VERSION = 1
# The tables a backup holds.
TABLES = ("papers", "highlights", "explanations", "notes", "chats", "folders", "saved", "settings", "overviews", "translations")


def dump_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, data JSON) rows of all tables."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("tbl"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("data"))
        out = rows if out is None else out.unionByName(rows)
    return out


def restore_table(dump: DataFrame, name: str, schema: T.StructType, key: Sequence[str], current: DataFrame) -> DataFrame:
    """Upsert a dumped table over the current one by key."""
    rows = dump.where(F.col("tbl") == name).select("data", F.from_json("data", schema).alias("r"))
    # Of rows with one key the largest counts, so that every restore gives the same table.
    rows = rows.groupBy(*[F.col(f"r.{k}").alias(k) for k in key]).agg(F.max_by("r", "data").alias("r")).select("r.*")
    return current.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    """Write one compressed JSON folder per table under ``path`` and a manifest beside them."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"not backup tables: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"app": APP, "version": VERSION, "tables": sorted(tables)})
    spark.range(1).select(F.lit(manifest).alias("value")).write.mode("overwrite").text(f"{path}/manifest")


def read_backup(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Tables of a backup; refuses folders that are not one."""
    # One line by construction.
    line = spark.read.text(f"{path}/manifest").first()
    manifest = json.loads(line.value) if line else {}
    if manifest.get("app") != APP:
        raise ValueError("not a backup of this application")
    return {n: spark.read.schema(schemas[n]).json(f"{path}/{n}") for n in manifest["tables"] if n in schemas}
