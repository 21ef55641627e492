"""Many searches at once, against a search for each."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F
from test_core import git, write

from codemass.operators import nearby, references, searches, traverse
from codemass.plans import scan as plans
from codemass.sources import trees

EDGES, ROOTS = "snapshot_id string, src string, dst string", "snapshot_id string, search string, node string"


def brute(edges, starts, depth=None, quota=None):
    out = {}
    for snap, a, b in edges:
        if a is not None and b is not None and a != b:
            out.setdefault((snap, a), set()).add(b)
    found = {}
    for snap, name, node in starts:
        if name is not None and node is not None:
            found.setdefault((snap, name), {})[node] = 0
    for (snap, _), met in found.items():
        todo, level = deque(met), 0
        while todo and (depth is None or level < depth) and (quota is None or len(met) <= quota):
            level += 1
            new = {b for a in todo for b in out.get((snap, a), ()) if b not in met}
            met.update(dict.fromkeys(new, level))
            todo = new
    return found


def test_searches_equal_one_search_each(spark):
    draw = random.Random(11)
    edges = [(draw.choice("tu"), f"n{draw.randrange(70)}", f"n{draw.randrange(70)}") for _ in range(150)]
    edges += [("t", "n0", f"n{i}") for i in range(70)] + [("t", None, "n1"), ("t", "n1", None), edges[0]]
    starts = [(snap, f"q{i}", f"n{draw.randrange(75)}") for snap in "tu" for i in range(90) for _ in range(draw.choice((1, 1, 3)))]
    starts += [("t", None, "n1"), ("t", "q1", None), starts[0], ("v", "q0", "n0")]
    e, r = spark.createDataFrame(edges, EDGES).repartition(5), spark.createDataFrame(starts, ROOTS).repartition(3)
    for depth, quota in ((None, None), (2, None), (0, None), (None, 1), (None, 12), (3, 40)):
        found, totals = searches.searches(e, r, max_depth=depth, quota=quota)
        want = brute(edges, starts, depth, quota)
        rows = [tuple(x) for x in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(s, q, n, h) for (s, q), met in want.items() for n, h in met.items()}, (depth, quota)
        assert {tuple(x) for x in totals.collect()} == {(s, q, len(met)) for (s, q), met in want.items()}
    assert searches.searches(e, r.limit(0))[0].isEmpty() and searches.searches(e.limit(0), r)[0].where("hops > 0").isEmpty()


def test_a_quota_ends_a_search_and_no_other(spark):
    """A wide anchor stops a level after its quota; the chain that shares its word goes on."""
    wide = [("s", "hub", f"a{i}") for i in range(3000)] + [("s", f"a{i}", f"b{i}") for i in range(3000)]
    chain = [("s", f"c{i}", f"c{i + 1}") for i in range(6)]
    e = spark.createDataFrame(wide + chain, EDGES)
    found, _ = searches.searches(e, spark.createDataFrame([("s", "hub", "hub"), ("s", "c0", "c0")], ROOTS), quota=250)
    got = {r["search"]: (r["n"], r["h"]) for r in found.groupBy("search").agg(F.count("*").alias("n"), F.max("hops").alias("h")).collect()}
    assert got == {"hub": (3001, 1), "c0": (7, 6)}
    anchors = spark.createDataFrame([("s", "hub"), ("s", "c0")], "snapshot_id string, node string")
    near = traverse.neighbourhood(e, anchors, max_depth=6)
    want = ["hub", *sorted(f"a{i}" for i in range(3000))[:249]]
    assert {r["node"] for r in near.where("anchor = 'hub' and truncated").collect()} == set(want) and near.where("anchor = 'c0' and not truncated").count() == 7
    exact = traverse.neighbourhood(e, anchors, max_depth=6, max_symbols=7).where("anchor = 'c0'")
    assert exact.count() == 7 and exact.where("truncated").isEmpty()


def test_references_name_their_boundaries(spark, tmp_path):
    tree = {
        ".github/workflows/a.yml": "run: scripts/one.sh\n", ".github/workflows/b.yml": "run: scripts/one.sh scripts/two.sh\n",
        "scripts/one.sh": "python scripts/deep.py\n", "scripts/two.sh": "python scripts/deep.py\n", "scripts/deep.py": "open('data/rows.csv')\n",
        "data/rows.csv": "1\n", "dead_a.sh": "sh dead_b.sh\n", "dead_b.sh": "sh dead_a.sh\n",
    }
    git(tmp_path, "init", "-q")
    write(tmp_path, tree)
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    s = plans.scan_commits(spark, str(tmp_path), trees.commits(spark, str(tmp_path), "HEAD"))
    files = s.files.select("snapshot_id", "path", "text").join(s.components.select("snapshot_id", "path", "category"), ["snapshot_id", "path"])
    a, b, one, two = (f"{p}" for p in (".github/workflows/a.yml", ".github/workflows/b.yml", "scripts/one.sh", "scripts/two.sh"))
    named = references.use(files, name_boundaries=True).where("kind = 'boundary_path_references'")
    got = {(r["path"], r["source"], r["boundary"]) for r in named.collect()}
    assert {x for x in got if x[0] == "scripts/deep.py"} == {("scripts/deep.py", one, a), ("scripts/deep.py", one, b), ("scripts/deep.py", two, b)}
    assert not {"dead_a.sh", "dead_b.sh"} & {x[0] for x in got}
    plain = references.use(files)
    assert "boundary" not in plain.columns
    assert {(r["path"], r["source"]) for r in plain.where("kind = 'boundary_path_references'").collect()} == {x[:2] for x in got}
    rows = plans.use_evidence(s)
    assert rows.where("kind = 'boundary_path_references' and boundary is null").isEmpty() and rows.where("kind = 'static_path_references' and boundary is not null").isEmpty()


def test_numbers_reached_are_told_by_components(spark):
    draw = random.Random(5)
    edges = [(draw.choice("tu"), f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(150)]
    edges += [("r", f"x{i}", f"x{(i + 1) % 40}") for i in range(40)] + [("r", "x3", "tail"), ("r", "head", "x9"), ("t", None, "n1"), ("t", "n1", "n1"), edges[0]]
    starts = [(snap, f"q{i}", f"n{draw.randrange(65)}") for snap in "tu" for i in range(70) for _ in range(draw.choice((1, 1, 3)))]
    starts += [("r", f"x{i}", f"x{i}") for i in range(40)] + [("r", "head", "head"), ("r", "tail", "tail"), ("v", "q", "lone"), ("t", None, "n1")]
    got = [tuple(r) for r in searches.reached(spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame(starts, ROOTS)).collect()]
    want = {(s, q, len(met)) for (s, q), met in brute(edges, starts).items()}
    assert len(got) == len(want) and set(got) == want
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)] + [(3, 100), (100, 101), (50, 51), (51, 50), (3, 50)], "src long, dst long")
    assert {tuple(r) for r in searches.components(ring).collect()} == {(i, 39) for i in range(40)} | {(50, 51), (51, 51)}


def test_a_level_holds_no_more_than_the_bound(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(draw.choice("tu"), f"n{draw.randrange(90)}", f"n{draw.randrange(90)}") for _ in range(400)] + [("t", "hub", f"n{i}") for i in range(90)]
    e = spark.createDataFrame(edges + [("t", None, "n1")], EDGES)
    starts = [(s, f"n{i}") for s in "tu" for i in range(0, 95, 9)] + [("t", "hub"), ("t", "hub"), ("t", None)]
    anchors = spark.createDataFrame(starts, "snapshot_id string, node string")
    sizes, keep = [], traverse.checkpointed

    def watched(df):
        out = keep(df)
        if "full" in out.columns:
            sizes.append(out.groupBy("root").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(traverse, "checkpointed", watched)
    monkeypatch.setattr(traverse, "_RUN", 7)
    got = [tuple(r) for r in traverse.neighbourhood(e, anchors, max_depth=3, max_symbols=20).collect()]
    want = set()
    for (snap, name), met in brute(edges, [(s, n, n) for s, n in starts], 3, 20).items():
        want |= {(snap, name, n, h, len(met) > 20) for h, n in sorted((h, n) for n, h in met.items())[:20]}
    assert len(got) == len(set(got)) and set(got) == want and any(r[4] for r in got)
    assert sizes and max(sizes) <= 21


def test_a_level_keeps_a_row_for_each_anchor(spark, monkeypatch):
    """Anchors that lie together share the lists of their nodes, and a level writes as many rows as there are anchors."""
    draw = random.Random(7)
    edges = [("s", f"h{draw.randrange(9)}", f"p{draw.randrange(60)}") for _ in range(200)]
    edges += [(s, b, a) for s, a, b in edges] + [("s", "h1", "h1")]
    starts = [("s", f"h{i}", f"h{i}") for i in range(10)]
    levels, keep = [], traverse.checkpointed

    def watched(df):
        out = keep(df)
        if "full" in out.columns:
            levels.append((out.count(), out.select("block").distinct().count()))
        return out

    monkeypatch.setattr(traverse, "checkpointed", watched)
    monkeypatch.setattr(traverse, "_ANCHORS", 4)
    e, anchors = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s, n) for s, _, n in starts], "snapshot_id string, node string")
    for bound in (1, 30, 500):
        levels.clear()
        got = {tuple(r) for r in traverse.neighbourhood(e, anchors, max_depth=3, max_symbols=bound).collect()}
        want = set()
        for (snap, name), met in brute(edges, starts, 3, bound).items():
            want |= {(snap, name, n, h, len(met) > bound) for h, n in sorted((h, n) for n, h in met.items())[:bound]}
        assert got == want and levels and all(n <= 10 and blocks > 1 for n, blocks in levels[:2])


def test_lists_are_told_apart_a_part_at_a_time(monkeypatch):
    """However few pairs are held at once and however lists arrive, an anchor has its least new neighbours."""
    draw = random.Random(13)
    lists = {n: sorted(draw.sample(range(300), draw.randrange(40))) for n in range(100)}
    met = [np.array([draw.randrange(100)] + draw.sample(range(100, 300), 5) + draw.sample(range(100), draw.randrange(9)), np.int64) for _ in range(12)]
    ends = [[6, len(m)] if len(m) > 6 else [1, 6, 6] for m in met]
    want = [sorted({v for n in m[(e[-2]) :] for v in lists.get(int(n), ())} - set(m.tolist())) for m, e in zip(met, ends, strict=True)]
    for pairs in (1, 50, 10**6):
        monkeypatch.setattr(nearby, "_PAIRS", pairs)
        block = nearby._Block(list(range(12)), met, ends, 24)
        nodes = sorted(lists)
        for some in (nodes[::2], nodes[1::2]):
            offsets = np.concatenate([[0], np.cumsum([len(lists[n]) for n in some])])
            block.add(np.array(some), offsets, np.array([v for n in some for v in lists[n]], np.int64))
        for (_, now, upto, full), m, e, new in zip(block.levels(), met, ends, want, strict=True):
            assert now.tolist() == [*m.tolist(), *new[: 25 - len(m)]] and upto == [*e, len(now)] and full == (len(now) > 24)


def test_unbounded_neighbourhoods_ship_runs_and_open_no_words(spark, monkeypatch):
    """A hub's neighbours come in runs, tasks follow the level's size, and no row is opened into 64."""
    monkeypatch.setattr(traverse, "_RUN", 3)
    monkeypatch.setattr(traverse, "_SHARE", 2, raising=False)
    r = random.Random(5)
    pairs = [(s, f"n{r.randrange(30)}", f"n{r.randrange(30)}") for s in "ab" for _ in range(50)] + [("a", "hub", f"n{i}") for i in range(30)] + [("a", "n0", "hub")] * 2
    begins = [("a", "hub"), ("a", "n0"), ("b", "n0"), ("b", "alone"), ("b", None), ("a", "n0")]
    e = spark.createDataFrame([*pairs, ("a", "n1", None), (None, "n0", "n1")], "snapshot_id string, src string, dst string")
    found = traverse.neighbourhood(e, spark.createDataFrame(begins, "snapshot_id string, node string"), max_depth=3, max_symbols=None)
    assert "sequence(0, 63" not in found._jdf.queryExecution().toString()
    want = set()
    for snapshot, anchor in {b for b in begins if b[1]}:
        level, seen = {anchor}, {anchor: 0}
        for depth in range(1, 4):
            level = {d for s, x, d in pairs if s == snapshot and x in level} - seen.keys()
            seen |= dict.fromkeys(level, depth)
        want |= {(snapshot, anchor, node, hops, False) for node, hops in seen.items()}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
