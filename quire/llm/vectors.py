"""Embedding near-duplicates: an exact metric range join with pivots.

Vectors are scaled to length one, where cosine 0.95 is a Euclidean distance. A vector's
home is the cell of its nearest pivot; it is also sent to every other cell whose members
could be within range. For the bisector of two pivots the triangle inequality gives the
bound: a vector nearer to pivot i than to pivot j by more than ``2 * radius * |pi-pj|`` in
squared distance has no neighbour in the cell of j. A cell then holds every neighbour of
its home vectors, and cells join independently.

Equal vectors are one row with a count before anything else, so a vector repeated by a
third of all rows costs one. A cell of any size is cut into blocks of home rows and
blocks of candidates of bounded size; each pair of blocks is one group, multiplies two
matrices, and returns per home row the number of links and, instead of the links, a
spanning forest of them. Candidates come from single precision with a margin and are
confirmed in double precision.

Where vectors show no structure (independent directions in many dimensions) the exact
bound excludes little, whatever the pivots, and the join tends to all pairs. If a vector
would go to more than half of the cells, they are one cell instead, cut into few large
blocks: two blocks meet once and count for both sides, so a vector is sent once to each
block, not twice to each cell. With structure (topics, copies) most cells are excluded.

Rows: one result per row with a vector id, repeated ids included. Null, zero, or
non-finite vectors and those with null components have no links; vectors of different
dimensions are compared only with their own kind; an empty table gives an empty result.
A row without an id is counted as a link of others and gets no component of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared
from quire.llm.components import components, forest
from quire.session import stage_table

COSINE = 0.95
#: Rows of a block; a cell is cut into blocks of about this size. One cell for all is cut into
#: WHOLE_BLOCKS blocks; what is sent grows with their number, so beyond that they become larger first.
BLOCK_ROWS, WHOLE_BLOCKS, MAX_BLOCK_ROWS = 4096, 8, 32768
#: So many distinct vectors per pivot. Pivots are at most MAX_PIVOTS, as all tasks hold them.
ROWS_PER_PIVOT, MAX_PIVOTS = 6000, 4096
MARGIN = 1e-4


def _unit(vector) -> tuple:
    """The vector scaled to length one as doubles, or None; and its dimension."""
    if vector is None or any(x is None for x in vector):
        return None, None
    v = np.asarray(vector, np.float64)
    if not v.size or not np.isfinite(v).all():
        return None, None
    top = np.abs(v).max()
    if top == 0:
        return None, None
    v = v / top  # keeps the squares in range
    return (v / np.linalg.norm(v)).tobytes(), v.size


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _place(units: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """Each vector with its home cell and all cells it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            home = np.zeros(b.num_rows, np.int64)
            cells: list = [None] * b.num_rows
            raw = b.column("unit").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = pivots[int(d)]
                dots = _matrix([raw[i] for i in at]) @ p.T
                near = dots.argmax(axis=1)
                gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[near]  # distance of the home pivot to the others
                # |x-pj|^2 - |x-pi|^2 = 2 (x.pi - x.pj), against 2 * radius * |pi-pj|
                sent = (dots[np.arange(len(at)), near][:, None] - dots) <= radius * gap + 1e-9
                for r, i in enumerate(at):
                    home[i] = near[r]
                    cells[i] = np.flatnonzero(sent[r])
            yield pa.RecordBatch.from_arrays(
                [b.column("vid"), b.column("dim"), b.column("copies"), b.column("unit"), pa.array(home), pa.array(cells, pa.list_(pa.int64()))],
                names=["vid", "dim", "copies", "unit", "home", "cells"],
            )

    return units.mapInArrow(run, "vid long, dim int, copies long, unit binary, home long, cells array<long>")


def _meet(left: pd.DataFrame, right: pd.DataFrame, cosine: float, both: bool = False) -> pd.DataFrame:
    """Links of home rows ``left`` with candidates ``right``: per home row (``both``: also per candidate) a count, and a forest of the links."""
    if not len(left) or not len(right):
        return pd.DataFrame({"vid": [], "n": [], "to": []})
    x, y = _matrix(left["unit"]), _matrix(right["other"])
    lid, rid, copies, own = left["vid"].to_numpy(), right["rid"].to_numpy(), right["copies"].to_numpy(), left["n"].to_numpy()
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    n, m = np.zeros(len(lid), np.int64), np.zeros(len(rid), np.int64)
    edges = []
    step = max(1, (1 << 21) // len(rid))  # products of a bounded size
    for s in range(0, len(lid), step):
        i, j = np.nonzero(x32[s : s + step] @ y32.T >= cosine - MARGIN)
        i += s
        other = lid[i] != rid[j]
        i, j = i[other], j[other]
        keep = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        np.add.at(n, i, copies[j])
        if both:
            np.add.at(m, j, own[i])
        edges.append(forest(lid[i], rid[j]))
    few = np.concatenate([*edges, np.zeros((0, 2), np.int64)])
    few = forest(few[:, 0], few[:, 1])
    linked, others = np.flatnonzero(n), np.flatnonzero(m)
    return pd.DataFrame({
        "vid": np.concatenate([lid[linked], rid[others], few[:, 0]]),
        "n": np.concatenate([n[linked], m[others], np.zeros(len(few), np.int64)]),
        "to": pd.array(np.concatenate([np.full(len(linked) + len(others), -1), few[:, 1]]), "Int64"),
    })


def range_links(units: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows ``(vid, n, to)``: ``n`` links counted for ``vid`` (to = -1), or a link of the spanning forest (n = 0).

    ``units``: distinct vectors ``(vid, dim, copies, unit)``.
    """
    spark = units.sparkSession
    sizes = {r["dim"]: r["count"] for r in units.groupBy("dim").count().collect()}  # one row per dimension
    pivots = {}
    for d, n in sizes.items():
        k = max(1, min(MAX_PIVOTS, round(n / ROWS_PER_PIVOT)))
        rows = units.where(F.col("dim") == d).orderBy(F.xxhash64("unit"), "vid").limit(k).select("unit").collect()
        pivots[d] = _matrix([bytes(r["unit"]) for r in rows])
    radius = math.sqrt(2 - 2 * cosine)
    placed = stage_table(_place(units, pivots, radius), "cells") if pivots else None
    if placed is None:
        return spark.createDataFrame([], "vid long, n long, to long")

    # One row per dimension: where a vector goes to most cells, all are one, of so many blocks.
    spread = {r["dim"]: r["cells"] for r in placed.groupBy("dim").agg(F.avg(F.size("cells")).alias("cells")).collect()}
    whole = {d: math.ceil(n / min(max(n / WHOLE_BLOCKS, BLOCK_ROWS), MAX_BLOCK_ROWS)) for d, n in sizes.items() if 2 * spread[d] > len(pivots[d])}
    table = spark.createDataFrame(list(whole.items()), "dim int, whole int")
    placed = placed.join(table, "dim", "left") if whole else placed.withColumn("whole", F.lit(None).cast("int"))
    one = F.col("whole").isNotNull()
    placed = placed.withColumn("home", F.when(one, -1).otherwise(F.col("home"))).withColumn("cells", F.when(one, F.array(F.lit(-1).cast("long"))).otherwise(F.col("cells")))

    # Blocks: a home row meets all candidate blocks of its cell, a candidate all home blocks; in the one
    # cell for all (-1) both sides have the same blocks, and two of them meet once.
    parts = F.when(F.max("whole").isNotNull(), F.max("whole")).otherwise(F.ceil(F.count("*") / BLOCK_ROWS).cast("int"))
    home = placed.groupBy("dim", F.col("home").alias("cell")).agg(parts.alias("home_blocks"))
    sent = placed.select("dim", "whole", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(parts.alias("sent_blocks"))
    blocks = stage_table(home.join(sent, ["dim", "cell"]), "blocks")
    part = lambda n: F.pmod(F.xxhash64("vid"), n).cast("int")
    left = placed.withColumn("cell", F.col("home")).join(blocks, ["dim", "cell"]).withColumn("hb", part(F.col("home_blocks")))
    sbs = F.sequence(F.when(one, F.col("hb")).otherwise(0), F.col("sent_blocks") - 1)
    left = left.select("dim", "cell", "hb", F.explode(sbs).alias("sb"), "vid", F.col("copies").alias("n"), "unit")
    right = placed.withColumn("cell", F.explode("cells")).join(blocks, ["dim", "cell"]).withColumn("sb", part(F.col("sent_blocks")))
    hbs = F.sequence(F.lit(0), F.when(one, F.col("sb")).otherwise(F.col("home_blocks") - 1))
    right = right.select("dim", "cell", F.explode(hbs).alias("hb"), "sb", "vid", "copies", "unit")
    # Other names on the right, as both sides come from one table.
    right = right.toDF("dim2", "cell2", "hb2", "sb2", "rid", "copies", "other")

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        _, cell, hb, sb = key
        return _meet(a, b, cosine, both=cell == -1 and hb != sb)

    pairs = left.groupBy("dim", "cell", "hb", "sb").cogroup(right.groupBy("dim2", "cell2", "hb2", "sb2"))
    return pairs.applyInPandas(meet, "vid long, n long, to long")


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``table`` (vec_id, embedding)."""
    prepared(table.sparkSession)
    fields = [T.StructField("unit", T.BinaryType()), T.StructField("dim", T.IntegerType())]
    rows = add_columns(table.select("vec_id", "embedding"), ["embedding"], fields, lambda: lambda v: _unit(v)).drop("embedding")
    # Equal directions meet in one row; it goes by the smallest id, and by a stand-in if none has one.
    code = F.when(F.col("dim").isNotNull(), F.sha2("unit", 256))
    rows = stage_table(rows.withColumn("code", code), "units")
    distinct = rows.where("dim is not null").groupBy("code").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim")
    )
    stand_in = -2 - F.pmod(F.xxhash64("code"), F.lit(1 << 61))
    distinct = stage_table(distinct.withColumn("vid", F.coalesce("vec_id", stand_in)), "vectors")
    found = stage_table(range_links(distinct.select("vid", "dim", "copies", "unit"), cosine), "links")
    counts = found.groupBy("vid").agg(F.sum("n").alias("n"))
    joined = components(found.where("n = 0").select(F.col("vid").alias("a"), F.col("to").alias("b")))
    # Stand-ins must not name a component; ids may be negative too, so they are told apart by their rows.
    real = distinct.where("vec_id is not null").select(F.col("vid").alias("node"))
    named = joined.join(real, "node", "left_semi").groupBy("component").agg(F.min("node").alias("least"))
    joined = joined.join(named, "component").select("node", F.col("least").alias("component"))
    classes = (
        distinct.select("code", "vid", "copies", F.col("vec_id").alias("least"))
        .join(counts, "vid", "left").join(joined, F.col("vid") == F.col("node"), "left")
        .select("code", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    linked = rows.where("dim is not null").select("vec_id", "code").join(classes, "code").select("vec_id", "n_links", "component_id")
    alone = rows.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
