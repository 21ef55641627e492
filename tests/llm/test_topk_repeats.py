"""Exact top-k where rows repeat an id, and where scores leave float64 or the long range."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemass.llm import topk

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows: list[tuple], is_query, k: int = 10) -> list[tuple]:
    sound = [(i, [math.floor(x * 1024) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if is_query(q):
            scores = [(min(max(sum(a * b for a, b in zip(v, w, strict=True)), LOW), HIGH), c) for c, w in sound if c != q and len(w) == len(v)]
            out += [(q, n + 1, c, s) for n, (s, c) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("same", [True, False])
def test_each_row_of_a_repeated_id_is_ranked(spark, same):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(0, 0.2, 20))]) for i in range(1, 101)]
    query = rows[-1][1]
    # high-scoring ids that fill more than all ten places, the second with vectors that differ
    rows += [(7, [x * (1 if same else 1 + n / 64) for x in query]) for n in range(30)] + [(100, query), (5, query), (5, rows[3][1])]
    for parts in (1, 5):
        got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(parts), F.col("vec_id") == 100, shards=3).collect()
        assert sorted(map(tuple, got)) == brute(rows, lambda q: q == 100) and len(got) == 20


@pytest.mark.parametrize("size", [3e6, 1e12, 1e30, 1e200])
def test_large_components_are_exact(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.2, 12)]) for i in range(60)]
    rows += [(60 + i, [float(x) * size for x in rnd.normal(0, 1, 12)]) for i in range(60)] + [(200, [size] * 12), (201, [0.0] * 12)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, shards=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda q: q % 20 == 0)


def test_many_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_BYTES", 2000)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.round(rnd.normal(0, 0.1, 6), 2)]) for i in range(300)] + [(None, [1.0]), (301, None), (302, []),
        (303, [1.0, None]), (304, [float("nan")])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(docs, F.col("vec_id") % 3 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda q: q % 3 == 0)
    assert topk.top_k(docs.limit(0), F.col("vec_id") == 0).count() == 0
    clash = docs.withColumns({"score": F.lit("x"), "_q": F.lit(1), "block": F.lit(2)})
    assert topk.top_k(clash, F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]
