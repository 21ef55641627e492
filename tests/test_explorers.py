"""Explorers, flags and journeys on small trees written out by hand."""

from __future__ import annotations

from codemass.operators import journeys, metabolism, select, surfaces
from codemass.plans import explore

SYMBOLS = "snapshot_id string, id string, path string, name string, qualified_name string, kind string, start_line int"
CHAINS = "snapshot_id string, symbol_ids array<string>, relationships array<string>, depth int"
EDGES = "snapshot_id string, source_id string, target_id string, kind string, resolution string, evidence string, edge_seq long"


def test_chain_explorer_and_flags(spark):
    symbols = spark.createDataFrame([("t", k, f"{k}.py", k, f"m.{k}", "function", n) for n, k in enumerate("abcd")], SYMBOLS)
    chains = spark.createDataFrame([("t", ["a", "b"], ["calls"], 1), ("t", ["a", "b", "gone"], ["calls", "imports"], 2), ("t", ["c", "d"], ["calls"], 1),
        ("u", ["x"], [], 0)], CHAINS)
    got = [tuple(r)[1:] for r in explore.chain_explorer(chains, symbols, keep=2).where("snapshot_id = 't'").orderBy("rank", "step").collect()]
    assert got == [(1, 0, "a", "m.a", "a.py", 0, None), (1, 1, "b", "m.b", "b.py", 1, "calls"), (1, 2, "gone", "gone", None, None, "imports"),
        (2, 0, "a", "m.a", "a.py", 0, None), (2, 1, "b", "m.b", "b.py", 1, "calls")]
    components = spark.createDataFrame([("t", f"{k}.py") for k in "abc"] + [("u", "x.py")], "snapshot_id string, path string")
    flags = {r["path"]: r["on_deepest_chain"] for r in explore.chain_flags(components, chains, symbols).collect()}
    assert flags == {"a.py": True, "b.py": True, "c.py": False, "x.py": False}
    assert explore.semantic_chains(chains.limit(0)).count() == 0


def test_edge_explorer_keeps_repeats_and_tells_the_rest(spark):
    edges = spark.createDataFrame([("t", "a", "b", "calls", "exact", "e1", 1), ("t", "a", "b", "calls", "exact", "e1", 2), ("t", "a", None, "calls", "exact", "", 3),
        ("t", "a", "c", "calls", "probable", "", 4), ("t", "b", "c", "imports", "exact", None, 5)], EDGES)
    reached = spark.createDataFrame([("t", "a", "a"), ("t", "a", "b"), ("t", "a", "b"), ("t", "z", "z")], "snapshot_id string, anchor string, id string")
    got = [tuple(r)[1:] for r in explore.edge_explorer(reached, edges, keep=2).orderBy("rank").collect()]
    assert got == [("a", 1, "a", "b", "calls", "e1", 1), ("a", 2, "a", "b", "calls", "e1", 1)]


def test_journeys_are_told_in_order(spark):
    symbols = spark.createDataFrame([("t", "T", "t.py", "T", "T", "class", 1), ("t", "save", "t.py", "save", "T.save", "method", 5),
        ("t", "emit", "t.py", "emit", "T.emit", "method", 3), ("t", "u", "a.py", "u", "u", "function", 9), ("t", "v", "a.py", "v", "v", "function", 2)], SYMBOLS)
    edges = spark.createDataFrame([("t", "T", m, "contains", "exact", "", n) for n, m in enumerate(("save", "emit"))] + [
        ("t", s, d, "calls", "exact", f"line {n}", n) for n, (s, d) in enumerate([("u", "save"), ("v", "save"), ("u", "T"), ("u", "save"), ("gone", "emit")], 10)], EDGES)
    types = spark.createDataFrame([("t", "T")], "snapshot_id string, type_id string")
    told = journeys.events(surfaces.journeys(types, symbols, edges), symbols).collect()
    assert [(r["role"], r["source_id"], r["target_id"]) for r in told] == [("created", "u", "T"), ("persisted", "v", "save"), ("persisted", "u", "save")]
    assert told[0]["evidence"] == "line 12; exact call resolves to selected class"
    assert told[2]["evidence"] == "line 10; exact call resolves to contained member 'T.save'; role derived from member name 'save'"
    ends = journeys.boundaries(types, symbols, edges).collect()
    assert [(r["role"], r["id"], r["called"]) for r in ends] == [("persisted", "save", True), ("emitted", "emit", False)]
    assert journeys.examined(types, edges).first()["exact_calls_examined"] == 5
    assert journeys.events(surfaces.journeys(types, symbols, edges.limit(0)), symbols).count() == 0
    assert journeys.examined(types, edges.limit(0)).first()["exact_calls_examined"] == 0


def test_data_symbols_come_by_name_in_any_letter_case(spark):
    rows = [("t", "3", "b.py", "x", "Beta", "class", 1), ("t", "2", "a.py", "x", "beta", "struct", 9), ("t", "1", "z.py", "x", "ALPHA", "enum", 1), ("t", "0", "z.py", "x", "a", "function", 1)]
    assert [r["id"] for r in select.data_symbols(spark.createDataFrame(rows, SYMBOLS)).collect()] == ["1", "2", "3"]


def test_superseded_is_whether_there_is_a_newer_sibling(spark):
    paths = [(r, f"ops/release_{n:02d}_{k}.sh") for r in ("x", "y") for n in (1, 2, 2, 30) for k in ("a", "b") if (r, n) != ("y", 30)] + [("x", "plain.sh")]
    rows = spark.createDataFrame(paths, "repository string, path string")
    want = {tuple(r) for r in metabolism.newer_siblings(rows).select("repository", "path").collect()}
    got = metabolism.superseded(rows).collect()
    assert {tuple(r) for r in got} == want and want and len(got) == len(want)
