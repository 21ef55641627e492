"""Rows of small files are spread over tasks before they grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codemass.operators import classify, surfaces
from codemass.plans import graph_queries, text_queries

SYMBOLS = "snapshot_id string, id string, path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, parent_id string"


def _symbols(spark):
    return spark.createDataFrame([("s", "i", "a/b.py", "python", "function", "f", "m.f", 1, 3, None), ("s", "j", "a/b.py", "python", "function", "g", "m.g", 5, 6, "i")], SYMBOLS)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["declared", "nearest_symbol", "module_symbol"])
def test_one_file_is_spread(spark, query):
    s = _symbols(spark)
    if query == "declared":
        df = classify.declared(s, spark.createDataFrame([("a", "x"), ("a/b.py", "y")], "prefix string, category string"))
        want = {("a/b.py", "y")}
        got = {(r["path"], r["declared"]) for r in df.collect()}
    elif query == "nearest_symbol":
        df = surfaces.nearest_symbol(spark.createDataFrame([("s", "a/b.py", 2, None), ("s", "a/b.py", 4, None)], "snapshot_id string, path string, line int, name string"), s)
        want, got = {(2, "i"), (4, "j")}, {(r["line"], r["symbol_id"]) for r in df.collect()}
    else:
        df = surfaces.module_symbol(spark.createDataFrame([("s", "b", "f"), ("s", "b", "h")], "snapshot_id string, module string, callable string"), s)
        want, got = {("f", "i"), ("h", None)}, {(r["callable"], r["symbol_id"]) for r in df.collect()}
    assert got == want
    assert "Repartition" in _plan(df)


def test_symbols_are_spread_before_they_are_refined(spark):
    s = _symbols(spark).withColumn("category", F.lit("core-product"))
    files = spark.createDataFrame([("s", "a/b.py", ["def f():", "  verify checksum"])], "snapshot_id string, path string, lines_of array<string>")
    df = classify.refine_symbols(s, files)
    assert {(r["id"], r["category"], r["role_source"]) for r in df.collect()} == {(k, "core-product", "file-seed-preserved") for k in "ij"}
    assert "Repartition" in _plan(df)


def test_parts_are_spread_before_words_are_looked_for(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "x", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "Repartition" in _plan(text_queries.classify_argmax(spark, str(tmp_path)))


def test_texts_are_spread_over_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    spark.createDataFrame([(k, "a b", "Brand#1", "X", 1) for k in range(10)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 1) for k in range(10)], "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert "RepartitionByExpression [path" in (plan := _plan(graph_queries.literal_references(spark, str(tmp_path)))) and ", 7" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
