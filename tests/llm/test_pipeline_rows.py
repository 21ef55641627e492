"""Stages of the pipeline judge rows, not doc_ids."""

from __future__ import annotations

import random

from test_llm_operators import prose
from test_pipeline import DOCS

import corpus_pipeline


def test_repeated_and_absent_ids(spark, tmp_path):
    rnd = random.Random(5)
    one, two, three, four, item = (prose(rnd, 60) for _ in range(5))
    leak = four + " " + item
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def docs(rows):
        return spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], DOCS).repartition(3)

    # copies under one id, a loser whose id names a kept row too, and copies without an id
    rows = [(1, one)] * 3 + [(2, one), (2, two), (None, one), (None, three), (None, three)]
    kept = corpus_pipeline.simhash_near_dedup(spark, docs(rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == sorted([(1, one), (2, two), (0, three)])
    rows = [(1, leak), (1, one), (None, leak), (None, two), (3, three), (3, three)]
    kept = corpus_pipeline.benchmark_decontamination(spark, docs(rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == sorted([(1, one), (0, two), (3, three), (3, three)])
