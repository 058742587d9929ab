"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Event times in the inputs are UTC without a zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Papers are dealt out by id, so joins on (paper, page) or (paper, sentence) find both sides in place.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Sessions of a busy key are merged before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Many operators do much work per byte, so small shuffles keep their tasks apart;
    # large ones are sized by parallelism and never get near this floor.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
}


PACKAGE_ZIP = "quire_package.zip"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per context: Python folds are pickled by name."""
    sc = spark.sparkContext
    if any(f.endswith(f"/{PACKAGE_ZIP}") for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), PACKAGE_ZIP)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere (the cluster's, the driver's) and ship the package."""
    ship_package(spark)
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "quire") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("quire.input.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back.

    Used between the stages of long pipelines whose later steps read a stage several times:
    the work is done once, and a lost executor re-reads files instead of repeating it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
