"""The pipeline against its stages done by brute force, and the registered queries' contracts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from test_llm_operators import brute_contained, brute_simhash, brute_substring, prose

import corpus_pipeline
from codemass.llm import packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    items = [(i, prose(rnd, 30)) for i in range(4)]
    shared = prose(rnd, 25)
    rows = []
    for i in range(60):
        t = prose(rnd, rnd.choice([3, 20, 60, 200]))
        if i % 5 == 0:
            t += shared + prose(rnd, 30)
        if i % 9 == 0:
            t += items[i % 4][1] + prose(rnd, 40)
        rows.append((i, t))
    rows += [(70, rows[4][1]), (71, rows[4][1]), (72, None), (73, ""), (74, "12 !! 34"), (75, shared)]
    docs = [(k, t, "xx" if k % 2 else "yy", "s", len(t or "")) for k, t in rows]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_pipeline_equals_brute_force(spark, corpus):
    folder, docs, items = corpus
    left = [(k, t) for k, t, *_ in docs if t and any(c.isalpha() for c in t)]
    first = {k: c for k, _, c in brute_simhash(left)}
    left = [(k, t) for k, t in left if first[k] == k]
    after = {k: (n, gone, kept) for k, n, gone, kept in brute_substring(left)}
    left = [(k, after[k][2] if after[k][1] else t) for k, t in left if after[k][1] < after[k][0] or not after[k][1]]
    leaks = {k for k, *_ in brute_contained(left, items)}
    left = [(k, t) for k, t in left if k not in leaks]
    words = packing.word_tokens(queries.tokenizer_path("word_bpe_49k.json"))
    want = sorted((k, len(ids) // 4, zlib.crc32(ids)) for k, t in left for ids in [words.ids(t) + np.asarray([2], "<u4").tobytes()])
    got = sorted((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and len(leaks) > 0 and 10 < len(want) < len(docs)


def test_stages_keep_columns_and_empty_tables(spark, corpus):
    folder, docs, _ = corpus
    empty = spark.createDataFrame([], DOCS + ", extra string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0
        if name != "sequence_packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
    nulls = spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None), (1, "more words", None, None, None)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, folder).count() >= 2, name


def test_query_columns(spark, corpus):
    folder, docs, _ = corpus
    q = queries.QUERIES
    rows = q["op9_language_id"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert q["op10_simhash"](spark, folder).columns == ["doc_id", "fingerprint", "component_id"]
    assert q["op8_substring_dedup"](spark, folder).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert q["op4_token_counts"](spark, folder).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert q["op3_packing"](spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
