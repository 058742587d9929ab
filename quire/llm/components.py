"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) joined back to the links,
so no node's neighbours meet in one task. Steps are written to the shared checkpoint
folder; the loop ends when all that is left are stars, each around its smallest node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stage_table


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link only, to a node without one of its own."""
    if not links.groupBy("u").count().where("count > 1").isEmpty():
        return False
    centres = links.select(F.col("v").alias("centre")).distinct()
    return links.join(centres, F.col("u") == F.col("centre"), "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has a link to another; the component is its smallest node.

    Links with a null end and links of a node to itself count for nothing; links may repeat.
    """
    pairs = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = stage_table(pairs, "links")
    while not _stars(pairs):
        pairs = stage_table(_small_star(_large_star(pairs)), "links")
    # Every node but the smallest of its component now has one link, to that smallest node.
    # ``pairs`` is a written table, so what follows is read and not worked out again.
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Links of a graph with the same components as the links ``i - j`` (node numbers), at most one per node.

    For a task's own links; ``components`` is for tables of them.
    """
    if not len(i):
        return np.zeros((0, 2), np.int64)
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[label[own]]], axis=1) if len(own) else np.zeros((0, 2), np.int64)
