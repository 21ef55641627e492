"""Joins and searches against brute force on random rows."""

from __future__ import annotations

import random
from collections import Counter, deque

from pyspark.sql import functions as F

from codemass.operators import corpus, surfaces, traverse

SYMBOLS = "snapshot_id string, id string, path string, name string, qualified_name string, kind string, parent_id string, start_line int, end_line int"
PRINTS = "repository string, sha string, scanned_at string, seq int, model string, canonical boolean, identity string, code_shares array<double>"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().sparkPlan().toString()


def random_symbols(draw, n=300):
    rows = []
    for k in range(n):
        start = draw.randrange(1, 90)
        name = draw.choice("abcd")
        outer = draw.choice([None, "x", "y"])
        kind = draw.choice(["function", "class", "file", "module"])
        place = draw.choice(["pkg/a.py", "a.py", "my/pkg/a.py", "b.go"])
        rows.append(("t", f"s{k}", place, name, f"{outer}.{name}" if outer else name, kind, outer, start, start + draw.choice([0, 0, 1, 3, 8, 40, -2])))
    return rows


def test_nearest_symbol_equals_brute_force(spark):
    draw = random.Random(3)
    symbols = random_symbols(draw)
    places = [("t", draw.choice(["pkg/a.py", "a.py", "none.py"]), draw.randrange(1, 110), draw.choice([None, "a", "x.b", "zz"]), k) for k in range(200)]
    places += places[:20]

    def best(path, line, name):
        found = []
        for _, i, p, n, q, kind, _, a, b in symbols:
            if p != path or kind in ("file", "module", "namespace"):
                continue
            if name in (n, q):
                found.append((0, abs(a - line), a, b - a, q, i))
            if a <= line <= b:
                found.append((1, b - a, a, b - a, q, i))
            if line <= a <= line + 8:
                found.append((2, a, a, b - a, q, i))
        return min(found)[-1] if found else None

    got = surfaces.nearest_symbol(
        spark.createDataFrame(places, "snapshot_id string, path string, line int, name string, k int"), spark.createDataFrame(symbols, SYMBOLS)
    )
    want = Counter((k, best(path, line, name)) for _, path, line, name, k in places)
    assert Counter((r["k"], r["symbol_id"]) for r in got.collect()) == want


def test_module_symbol_equals_brute_force(spark):
    draw = random.Random(4)
    symbols = random_symbols(draw, 40)
    wanted = [("t", m, c, k) for k, (m, c) in enumerate((m, c) for m in ("a", "pkg.a", "my.pkg.a", "kg.a", "none") for c in ("a", "b", "c", "d", "q"))]

    def one(module, callable_):
        end = module.replace(".", "/") + ".py"
        hit = [s for s in symbols if s[2].endswith(end) and callable_ in (s[3], s[4].split(".")[-1])]
        top = [s for s in hit if s[6] is None]
        return hit[0][1] if len(hit) == 1 else top[0][1] if len(top) == 1 else None

    frame = spark.createDataFrame(wanted, "snapshot_id string, module string, callable string, k int")
    got = surfaces.module_symbol(frame, spark.createDataFrame(symbols, SYMBOLS))
    assert {r["k"]: r["symbol_id"] for r in got.collect()} == {k: one(m, c) for _, m, c, k in wanted}


def test_exclusions_equal_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for k in range(150):
        repository = draw.choice(["o/a", "O/A", "o/b", "o/c", None])
        shares = None if k % 11 == 0 else [float(k % 3), 1.0]
        rows.append((repository, "s", "2024", k, draw.choice(["m", "n", None]), draw.choice([True, False, None]),
                draw.choice(["i", "j", f"k{k}", None]), shares))
    asked = [r for r in rows if r[3] % 5 == 0] + rows[:3]
    low = lambda x: None if x is None else x.lower()

    for same_repository in (False, True):
        for cross_model in (False, True):
            want = Counter()
            for q in asked:
                for c in rows:
                    if c[7] is None:
                        want[q[6], "invalid"] += 1
                    elif c[6] is not None and c[6] == q[6]:
                        want[q[6], "same_identity"] += 1
                    elif not same_repository and low(c[0]) is not None and low(c[0]) == low(q[0]):
                        want[q[6], "same_repository"] += 1
                    elif not cross_model and (c[4] is None or c[4] != q[4] or c[5] != q[5]):
                        want[q[6], "measurement_mismatch"] += 1
            got = corpus.exclusions(spark.createDataFrame(asked, PRINTS), spark.createDataFrame(rows, PRINTS), same_repository=same_repository,
                cross_model=cross_model)
            assert {(r["query"], r["reason"]): r["records"] for r in got.collect()} == dict(want)
            assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    empty = spark.createDataFrame([], PRINTS)
    assert corpus.exclusions(spark.createDataFrame(asked, PRINTS), empty).isEmpty() and corpus.exclusions(empty, empty).isEmpty()


def test_hops_equal_breadth_first_search(spark):
    draw = random.Random(6)
    edges = [("t", str(draw.randrange(60)), str(draw.randrange(60))) for _ in range(70)]
    roots = [("t", "0"), ("t", "7"), ("t", "lone")]
    for directed in (True, False):
        out = {}
        for _, a, b in edges:
            out.setdefault(a, set()).add(b)
            if not directed:
                out.setdefault(b, set()).add(a)
        want = {r: 0 for _, r in roots}
        todo = deque(want)
        while todo:
            at = todo.popleft()
            for b in out.get(at, ()):
                if b not in want:
                    want[b] = want[at] + 1
                    todo.append(b)
        found = traverse.hops(spark.createDataFrame(edges, "snapshot_id string, src string, dst string"),
            spark.createDataFrame(roots, "snapshot_id string, node string"), directed=directed)
        rows = [(r["node"], r["hops"]) for r in found.select("node", F.col("hops")).collect()]
        assert len(rows) == len(want) and dict(rows) == want
