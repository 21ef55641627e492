"""Strongest paths by branch and bound against all paths, and graphs that have too many of them."""

from __future__ import annotations

import random

import pytest

from codemass.operators import traverse
from codemass.plans import explore, graph_queries

CALLS, SYMBOLS = "snapshot_id string, src string, dst string, edge_seq long", "snapshot_id string, id string, path string, category string, kind string, name string, qualified_name string, start_line int, end_line int"


def symbols_of(spark, rows: list[tuple]):
    return spark.createDataFrame([("s", i, path, category, "function", i, i, 1, 2) for i, path, category in rows], SYMBOLS)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_paths(spark, seed):
    rnd = random.Random(seed)
    n = 12
    symbols = symbols_of(spark, [(f"n{i:02}", f"f{rnd.randrange(4)}", rnd.choice("abc")) for i in range(n - 1)])  # the last node has no symbol
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(26)}
    calls = spark.createDataFrame([("s", f"n{a:02}", f"n{b:02}", k) for k, (a, b) in enumerate(sorted(edges))], CALLS)
    roots = spark.createDataFrame([("s", f"n{i:02}") for i in (0, 1, 2, 2, n - 1)] + [("s", "alone")], "snapshot_id string, node string")
    for depth, keep, beam in ((5, 2, 1), (7, 6, 32)):
        all_paths, _ = traverse.value_paths(calls, roots.distinct(), max_depth=depth, budget=None)
        want = traverse.rank_paths(all_paths, symbols, keep=keep)
        got = traverse.strongest_paths(calls, roots, symbols, max_depth=depth, keep=keep, beam=beam)
        columns = ["root", "rank", "ids", "depth", "distinct_files", "distinct_categories"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_many_equal_paths_are_not_listed(spark):
    wide, deep = 4, 12
    name = lambda level, k: f"l{level:02}_{k}"
    edges = [("s", "root", name(1, k), k) for k in range(wide)]
    edges += [("s", name(level, a), name(level + 1, b), level * 100 + a * 10 + b) for level in range(1, deep) for a in range(wide) for b in range(wide)]
    calls = spark.createDataFrame(edges, CALLS)  # 4 ** 12 paths
    symbols = symbols_of(spark, [("root", "r", "a")] + [(name(level, k), f"f{level}", "a") for level in range(1, deep + 1) for k in range(wide)])
    roots = spark.createDataFrame([("s", "root")], "snapshot_id string, node string")
    got = traverse.strongest_paths(calls, roots, symbols, beam=8)
    rows = got.orderBy("rank").collect()
    assert [r["ids"][-1] for r in rows] == [name(12, 0), name(12, 1), name(12, 2), name(12, 3), name(12, 0), name(12, 1)]
    assert rows[0]["ids"] == ["root"] + [name(level, 0) for level in range(1, 13)] and rows[0]["distinct_files"] == 13
    steps = traverse.path_steps(got, symbols, calls).where("rank = 1").orderBy("step").collect()
    assert [r["symbol_id"] for r in steps] == rows[0]["ids"] and steps[0]["edge_seq"] is None and steps[2]["edge_seq"] == 100


def test_no_calls_and_no_roots(spark):
    symbols = symbols_of(spark, [("a", "f", "x")])
    calls, roots = spark.createDataFrame([], CALLS), spark.createDataFrame([("s", "a")], "snapshot_id string, node string")
    assert [(r["ids"], r["depth"]) for r in traverse.strongest_paths(calls, roots, symbols).collect()] == [(["a"], 0)]
    assert traverse.strongest_paths(calls, roots.limit(0), symbols).count() == 0


def _machine_graph(spark):
    """Product and machinery symbols with parallel edges and cycles; some have several least paths to choose from."""
    n = 24
    category = lambda k: ("core-product", "testing", "verification", "audit-provenance")[k % 4]
    s = spark.createDataFrame([("s", f"n{k:02d}", f"n{k:02d}", category(k), "function", k) for k in range(n)],
        "snapshot_id string, id string, path string, category string, kind string, code_lines int")
    e = [("s", f"n{(k * 5 + j) % n:02d}", f"n{k:02d}", ("calls", "imports", "inherits")[(k + j + p) % 3], "exact", (k * 7919 + j * 31 + p * 1009) % 10007)
        for k in range(n) for j in range(3) for p in range(2)]
    return s, spark.createDataFrame(e, "snapshot_id string, source_id string, target_id string, kind string, resolution string, edge_seq bigint")


def test_coded_chains_equal_budgeted_ones(spark):
    """Without a budget chains are kept as numbers, a shuffle a level; they and their account equal those under a budget that never ends."""
    from pyspark.sql import functions as F

    s, e = _machine_graph(spark)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    whole, spent = traverse.recursive_chains(s, e, max_depth=5, budget=10**9)
    coded, again = traverse.recursive_chains(s, e, max_depth=5, budget=None)
    columns = ["snapshot_id", "root", "symbol_ids", "relationships", "depth"]
    assert rows(coded.select(columns)) == rows(whole.select(columns)) and coded.count() > 50
    assert rows(again) == rows(spent)
    g = e.select("snapshot_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    whole, spent = traverse.audit_chains(s, g, max_depth=4, budget=10**9)
    coded, again = traverse.audit_chains(s, g, max_depth=4, budget=None)
    columns = ["snapshot_id", "root", "paths", "depth"]
    assert rows(coded.select(columns)) == rows(whole.select(columns)) and rows(again) == rows(spent)
    codes, names, _ = traverse.audit_chain_codes(s, g, max_depth=4)
    columns += ["total_lines", "rank"]
    for keep in (3, 10**6):
        assert rows(traverse.top_chain_codes(codes, names, keep=keep).select(columns)) == rows(traverse.top_chains(whole, s, keep=keep).select(columns))


def test_chain_rows_hold_numbers(spark):
    """What a level keeps and shuffles of a chain are numbers of symbols and edges."""
    codes, _, _ = traverse.recursive_chain_codes(*_machine_graph(spark), max_depth=3)
    assert dict(codes.dtypes)["codes"] == "array<int>"


def test_chains_are_followed_root_by_root(spark, monkeypatch):
    """Depths, counts and the deepest chains of two snapshots equal those of all chains, and no level is written."""
    from pyspark.sql import functions as F

    s, e = _machine_graph(spark)
    rest = F.substring("source_id", 2, 2).cast("int") % 4 > 1
    s, e = s.union(s.withColumn("snapshot_id", F.lit("t"))), e.union(e.withColumn("snapshot_id", F.lit("t")).where(rest))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    every, _ = traverse.recursive_chains(s, e, max_depth=7, budget=None)
    every = every.localCheckpoint()
    want = every.groupBy("snapshot_id", "root").agg(F.max("depth").alias("max_depth"), F.count("*").alias("chains"))
    kept, write = [], traverse.checkpointed
    monkeypatch.setattr(traverse, "checkpointed", lambda df: kept.append(df.schema.simpleString()) or write(df))
    assert rows(traverse.recursive_depths(s, e, max_depth=7)) == rows(want.drop("snapshot_id")) and want.count() == 12
    for keep in (1, 3, 10**6):
        best, names = traverse.deepest_recursive(s, e, max_depth=7, keep=keep)
        best = traverse.decoded(best, names, "symbol_ids")
        top = lambda df: rows(explore.semantic_chains(df, keep=keep).select("snapshot_id", "rank", "depth", "symbol_ids"))  # noqa: B023, E731
        assert top(best) == top(every) and (keep < 9 or best.count() == every.count())
    alone = e.where("snapshot_id = 's'")
    monkeypatch.setattr(graph_queries, "frame", lambda spark, sf, name: s.where("snapshot_id = 's'") if name == "symbols" else alone)
    assert graph_queries.recursive_chain_depth(spark, "").count() == 6 and graph_queries.recursive_chain_topk(spark, "").count() == 50
    assert kept and not any("array" in k for k in kept)
    assert traverse.recursive_depths(s, e.where("false")).count() == 0


def test_levels_of_paths_hold_numbers_alone(spark, monkeypatch):
    """Two snapshots with the same ids and other symbols: equal to all paths, and no level keeps a name or what may follow."""
    kept, write = [], traverse.checkpointed
    monkeypatch.setattr(traverse, "checkpointed", lambda df: kept.append(df.schema) or write(df))
    rnd = random.Random(3)
    symbols = spark.createDataFrame([(s, f"n{i}", f"f{rnd.randrange(3)}", rnd.choice(["a", "b", None]), "function", "x", "x", 1, 2) for s in "pq" for i in range(8)], SYMBOLS)
    calls = spark.createDataFrame([(s, f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", k) for s in "pq" for k in range(18)], CALLS)
    roots = spark.createDataFrame([(s, f"n{i}") for s in "pq" for i in range(3)], "snapshot_id string, node string")
    columns = ["snapshot_id", "root", "rank", "ids", "depth", "distinct_files", "distinct_categories"]
    got = traverse.strongest_paths(calls, roots, symbols, max_depth=4, keep=2, beam=2).select(columns).collect()
    levels = [k for k in kept if "ids" in k.names]
    assert levels and not any("string" in k.simpleString() or "_to" in k.names for k in levels)
    every, _ = traverse.value_paths(calls, roots, max_depth=4, budget=None)
    assert sorted(map(str, got)) == sorted(map(str, traverse.rank_paths(every, symbols, keep=2).select(columns).collect()))
