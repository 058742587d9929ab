"""op4: vectors without structure are one cell, whose blocks meet once and count for both sides."""

import numpy as np

from quire.llm import vectors
from tests.llm.test_dedup import brute_vectors


def test_vectors_without_structure_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    free = rng.normal(size=(150, 64))
    near = free[:40] + rng.normal(size=(40, 64)) * 0.02
    rows = [(k - 20, v.tolist()) for k, v in enumerate([*free, *near, *near[:10], *free[5:9]])]
    monkeypatch.setattr(vectors, "ROWS_PER_PIVOT", 25)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    staged, stage = {}, vectors.stage_table
    monkeypatch.setattr(vectors, "stage_table", lambda df, name: staged.setdefault(name, stage(df, name)))
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert [(r.cell, r.home_blocks, r.sent_blocks) for r in staged["blocks"].collect()] == [(-1, 8, 8)]
