"""Queries read every row of their tables and every path of their graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_core import components, graph, links, symbols

from codemass.operators import traverse
from codemass.plans import graph_queries, proxies, text_queries


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Eight parts and a few lines of odd and even orders, none of them dealt by a filter."""
    folder = str(tmp_path_factory.mktemp("small"))
    parts = [(k, f"red bolt {k}", f"Brand#{k % 3}", "STEEL", k + 1) for k in range(8)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    lines = [(o, n, (o * 3 + n) % 8, (o + n) % 5, "ARN"[(o + n) % 3], "O") for o in range(1, 8) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return folder, lines


def test_every_line_gives_an_edge(spark, small):
    folder, lines = small
    pairs = {(p, (p * 7 + s) % 8) for _, _, p, s, *_ in lines}
    assert {tuple(r) for r in proxies.frame(spark, folder, "pairs").collect()} == pairs
    edges = proxies.frame(spark, folder, "edges")
    ends = {tuple(int(v.rsplit("_", 1)[1][:-3]) for v in r) for r in edges.select("src", "dst").collect()}
    assert ends == {(a, b) for a, b in pairs if a != b}
    for name in ("links", "named_links"):
        assert proxies.frame(spark, folder, name).select(F.countDistinct("edge_seq")).first()[0] == len(lines), name


def test_neighbourhood_of_a_wide_anchor(spark):
    edges = spark.createDataFrame([("s", "a", f"n{i}") for i in range(300)], "snapshot_id string, src string, dst string")
    anchors = spark.createDataFrame([("s", "a")], "snapshot_id string, node string")
    found = traverse.neighbourhood(edges, anchors, max_symbols=None)
    assert found.count() == 301 and found.where("truncated").count() == 0
    assert traverse.neighbourhood(edges, anchors).count() == 250


def test_budget_keeps_what_fits(spark):
    c = components(spark, [("app", "core-product", 1), *[(f"v{i}", "verification", 1) for i in range(9)]])
    g = graph(spark, [(f"v{i}", "app") for i in range(9)] + [("v0", "v1")])
    cut, spent = traverse.audit_chains(c, g, budget=4)
    assert sorted(r["paths"][1] for r in cut.collect()) == ["v0", "v1", "v2", "v3"]
    assert tuple(spent.first()) == ("s", 4, True)
    whole, spent = traverse.audit_chains(c, g, budget=None)
    assert whole.count() == 10 and tuple(spent.first()) == ("s", 10, False)
    s = symbols(spark, [("core", "function", "core-product"), *[(f"v{i}", "function", "verification") for i in range(9)]])
    e = links(spark, [(f"v{i}", "calls", "core", "exact") for i in range(9)])
    cut, spent = traverse.recursive_chains(s, e, budget=4)
    assert sorted(r["symbol_ids"][1] for r in cut.collect()) == ["v0", "v1", "v2", "v3"] and spent.first()["truncated"]
    calls = graph(spark, [("a", f"n{i}") for i in range(9)] + [("n0", "z")])
    root = spark.createDataFrame([("s", "a")], "snapshot_id string, node string")
    cut, spent = traverse.value_paths(calls, root, budget=4)
    assert sorted((r["ids"][-1], r["complete"]) for r in cut.collect()) == [("n0", False), ("n1", True), ("n2", True),
        ("n3", True)] and spent.first()["truncated"]


def test_registered_chains_have_no_budget(spark, monkeypatch):
    """A star that passes every default budget: chains of all its points come back."""
    n = 100_001
    each = spark.range(n).select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("path"),
        F.lit("verification").alias("category"), F.lit(1).cast("long").alias("code_lines"))
    app = spark.createDataFrame([("s", "app", "core-product", 1)], each.schema)
    tables = {"components": each.union(app), "edges": each.select("snapshot_id", F.col("path").alias("src"), F.lit("app").alias("dst"))}
    monkeypatch.setattr(graph_queries, "frame", lambda spark, sf, name: tables[name])
    assert graph_queries.audit_chain_depth(spark, "").count() == 1
    assert graph_queries.audit_chain_topk(spark, "").count() == 25


def test_chain_diff_compares_all_parts(spark, monkeypatch):
    pairs = [(a, (a * 7 + k) % 900) for a in (3, 150, 200, 471, 899) for k in range(4)]
    monkeypatch.setattr(graph_queries, "frame", lambda spark, sf, name: spark.createDataFrame(pairs, "a long, b long"))

    def chains(rest):
        return {f"s{a % 17} -> m{b} -> t{a % 5}" for a, b in pairs if b % 3 != rest}

    got = graph_queries.chain_diff(spark, "").collect()
    assert {r["before"] for r in got} - {None} == chains(0) - chains(1)
    assert {r["after"] for r in got} - {None} == chains(1) - chains(0)


def test_whole_texts_are_read(spark, monkeypatch):
    long = "word " * 30 + "Last.name"
    talk = spark.createDataFrame([(1, 0, "user", long)], "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(text_queries, "frame", lambda spark, sf, name: talk)
    assert text_queries.target_names(spark, "").first()["target"] == "Last.name.Run"
    late = "x " * 70_000 + "audit report checker verification audit validate"
    tables = {
        "files": spark.createDataFrame([("docs", 1, "a.md", "c", late)], "snapshot_id string, doc_id long, path string, language string, text string"),
        "part": spark.createDataFrame([], "p_partkey long, p_name string"),
    }
    monkeypatch.setattr(text_queries, "frame", lambda spark, sf, name: tables[name])
    assert text_queries.classify_argmax(spark, "").first()["signals"] > 1
