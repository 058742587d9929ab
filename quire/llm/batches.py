"""Running Python over documents in bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship_package

# Documents may hold hundreds of thousands of characters, so a batch holds few rows.
ROWS_PER_BATCH = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors once per context and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    ship_package(spark)
    return spark


def add_columns(
    df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField], make: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """``df`` with ``fields`` computed row by row from the columns ``inputs``.

    ``make`` runs once per task and returns the row function; that one gets the inputs of
    a row and returns one value per field. A column of ``df`` with a field's name is replaced.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    # Inputs travel under own names, so that an input may also be a replaced column.
    prefix = "_in"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    work = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*[work.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        row = make()
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            out: list[list] = [[] for _ in fields]
            cols = [b.column(f"{prefix}{i}") for i in range(len(inputs))]
            for r in range(b.num_rows):
                for o, v in zip(out, row(*[c[r].as_py() for c in cols]), strict=True):
                    o.append(v)
            arrays = [b.column(c) for c in kept] + [pa.array(o, k) for o, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return work.mapInArrow(run, schema)
