"""Clusters against plain Lloyd's rounds in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemass.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"
HIGH = (1 << 63) - 1


def brute(rows: list[tuple], k: int, rounds: int, dims: int, scale: int = 256) -> list[tuple]:
    kept = [(i, [math.floor(min(max(x * scale, -1.7976931348623157e308), 1.7976931348623157e308)) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    part = [sum(min(d, HIGH) for _, d, n in last if n == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, min(d, HIGH), min(part[n], HIGH), min(sum(part), HIGH), sha[n]) for i, d, n in last), key=str)


def around(rnd: np.random.Generator, n: int, dims: int, groups: int = 5) -> list[list[float]]:
    middle = rnd.normal(0, 1, (groups, dims))
    return [[float(x) for x in middle[i % groups] + rnd.normal(0, 0.2, dims)] for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 1e4, 1e9, 1e150])
def test_clusters_equal_plain_rounds(spark, size):
    rnd = np.random.default_rng(3)
    rows = [(i, [x * (size if i % 7 == 0 else 1.0) for x in v]) for i, v in enumerate(around(rnd, 150, 6))]
    # repeated ids with equal and other vectors, equal vectors, no id, and what takes no part
    rows += [(3, rows[3][1]), (4, rows[9][1]), (500, rows[9][1]), (None, rows[5][1]), (501, None), (502, []), (503, [1.0] * 5), (504, [1.0] * 5 + [None]),
        (505, [1.0] * 5 + [float("nan")]), (506, [float("-inf")] + [1.0] * 5)]
    for parts in (1, 4):
        got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(parts), k=8, rounds=3, dims=6, leading=2)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 8, 3, 6)


def test_ties_and_few_vectors(spark):
    rows = [(i, [0.0, 1.0]) for i in range(5)] + [(9, [0.0, -1.0]), (None, [0.5, 0.5])]
    for k in (1, 3, 40):
        got = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=k, rounds=2, dims=2, leading=1)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, 2, 2)
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert centroids.cluster(empty, dims=2).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("x"), "_v": F.lit(1), "ids": F.lit(2)})
    assert sorted(map(tuple, centroids.cluster(clash, k=3, rounds=2, dims=2, leading=1).collect()), key=str) == brute(rows, 3, 2, 2)


def test_blocks_are_cut_and_most_pairs_are_not_measured(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 32)
    rnd = np.random.default_rng(5)
    x = np.floor(256 * np.array(around(rnd, 2000, 64, 20))).astype(np.int64)
    rows = [(i, [float(v) / 256 for v in row]) for i, row in enumerate(x[:300])]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(2), k=20, rounds=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20, 2, 64)
    spread = np.cov(x.T)
    rotation = centroids.Rotation(x.mean(0), np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1]), 16)
    lead, rest = rotation.project(x.astype(float))
    chosen, best, measured = centroids.nearest(x, lead, rest, x[:20].tolist(), rotation)
    whole = ((x[:, None, :] - x[None, :20, :]) ** 2).sum(2)
    assert (chosen == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert measured < 0.2 * whole.size
