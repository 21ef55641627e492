"""Names of relationships: every tier against a model, and one reading of the edges however many tiers there are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codemass.functions.text import normal_target
from codemass.operators import resolve

SYMBOLS = ("snapshot_id string, id string, path string, language string, kind string, name string, qualified_name string, start_line int,"
    " parent_id string")
EDGES = "snapshot_id string, edge_seq long, source_id string, kind string, target_name string, target_id string, resolution string"


def tree(seed: int):
    r = random.Random(seed)
    symbols = [("s", f"n{i}", f"lib/m{r.randrange(5)}.py", r.choice(["python", "go", None]), r.choice(["function", "class", "file"]), n := f"f{r.randrange(14)}",
        r.choice([n, f"C{r.randrange(4)}.{n}"]), r.randrange(40), r.choice([None, "p0", "p1"])) for i in range(90)]
    names = ["f%d", "C1.f%d", "m2.f%d", "lib.m3.C1.f%d", "::f%d", "(C2.f%d)", "none%d", "no.where%d", " %d f1", ""]
    wanted = [n % r.randrange(14) if "%" in n else n for n in r.choices(names, k=400)]
    return symbols, [("s", k, f"n{r.randrange(95)}", r.choice(["calls", "contains"]) if k % 9 == 0 else "calls", w, None, "unresolved") for k, w in enumerate(wanted)]


def model(symbols, edges):
    answers, places = {}, {s[1]: s for s in symbols}

    def first(rows):
        return min(rows, key=lambda s: (s[2], s[7], s[6], s[1]))[1]

    for _, seq, source, kind, target, *_ in edges:
        if kind == "contains" or source not in places:
            continue
        t = target.strip().replace("::", ".").strip("()").split(" ")[-1].strip(".")
        src, dotted = places[source], "." in t
        stem = lambda s: s[2].removesuffix(".py").replace("/", ".")
        refs = lambda s: {s[6], s[5], f"{stem(s)}.{s[6]}", f"{stem(s)[4:]}.{s[6]}"} if dotted else {s[5], s[6]}
        hit = [s for s in symbols if s[4] != "file" and t and t in refs(s)]
        here, tongue = [s for s in hit if s[2] == src[2]], [s for s in hit if s[3] is not None and s[3] == src[3]]
        near = [s for s in here if s in tongue] if dotted else [s for s in here if s[8] == src[8]]
        if len(near) == 1:
            answers[seq] = (near[0][1], "exact")
        elif not dotted and len(here) == 1:
            answers[seq] = (here[0][1], "exact")
        elif tongue:
            answers[seq] = (first(tongue), "exact" if dotted and len(tongue) == 1 else "probable")
        else:
            answers[seq] = (first(hit), "probable") if hit else (None, "unresolved")
    return answers


@pytest.mark.parametrize("held", [400_000, -1])
def test_tiers_of_names(spark, monkeypatch, held):
    monkeypatch.setattr(resolve, "_HELD", held)
    symbols, edges = tree(7)
    got = resolve.resolve_names(spark.createDataFrame(edges, EDGES), spark.createDataFrame(symbols, SYMBOLS)).collect()
    assert {r["edge_seq"]: (r["target_id"], r["resolution"]) for r in got} == model(symbols, edges) and len({r["resolution"] for r in got}) == 3


def test_edges_are_read_and_shuffled_once(spark, tmp_path):
    symbols, edges = tree(8)
    spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/edges")
    got = resolve.resolve_names(spark.read.parquet(f"{tmp_path}/edges"), spark.createDataFrame(symbols, SYMBOLS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 3


def test_plain_names_need_no_rewriting(spark):
    names = ["a", "a.b.c", ".a", "a.", "a::b", "x->y", "import a.b", "new Foo", "(a)", "", "a..b", " a ", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(normal_target(F.col("n"))).collect()]
    assert got == ["a", "a.b.c", "a", "a", "a.b", "x.y", "import a.b", "Foo", "a", "", "a..b", "a", None]
