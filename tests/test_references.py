"""Literal references against escaped patterns searched in whole texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codemass.operators import references

SCHEMA = "snapshot_id string, path string, text string, category string"


def forms_of(source: str, target: str) -> list[str]:
    """The root form and the shortest form from the source's folder, longest first."""
    here, there = source.split("/")[:-1], target.split("/")
    same = 0
    while same < min(len(here), len(there)) and here[same] == there[same]:
        same += 1
    short = "/".join([".."] * (len(here) - same) + there[same:])
    found = {target, f"./{target}", short} | ({f"./{short}"} if not short.startswith(".") else set())
    return sorted(found, key=lambda f: (-len(f), f))


def brute(files: list[tuple]) -> set[tuple]:
    out = set()
    for snap, source, text, _ in files:
        for snap2, target, _, _ in files:
            if snap != snap2 or source == target:
                continue
            for form in forms_of(source, target):
                before = "(?<![A-Za-z0-9_.-])" if "/" in form else "(?<![A-Za-z0-9_./-])"
                if re.search(before + re.escape(form) + "(?![A-Za-z0-9_./-])", text or ""):
                    out.add((snap, source, target, form))
                    break
    return out


def found(spark, files: list[tuple]) -> set[tuple]:
    rows = references.literal_references(spark.createDataFrame(files, SCHEMA).repartition(3)).collect()
    assert len(rows) == len({(r[0], r[1], r[2]) for r in rows})
    return {tuple(r) for r in rows}


ODD = [
    "src/app/(auth)/page.tsx", "docs/My File.md", "pkg/@scope/x.ts", "src/é.py", "b.py", "foo/c.py", "src/app/[id]/page.tsx", "a+b/c++", "日本", "docs/日本",
    "docs/語/日本.md", "notes (1)", "docs/notes (1).txt", "x y z/w v.txt", "~tmp", "src/page.tsx", "c++", ".env", "sub/.env", "sub/deep/own.py", "sub/own.py",
    "(auth)/page.tsx", "a$b.py", "a.b", "-x/y", "docs/  two  gaps .md", "sub/(x)(y)", "☃/☃☃", "k=v/it's.md", "a,b.csv", "sub/#1/a,b.csv",
]


def test_named_examples(spark):
    text = 'open("src/app/(auth)/page.tsx") docs/My File.md, pkg/@scope/x.ts; src/é.py foo/../b.py'
    files = [("s", "run.sh", text, "x")] + [("s", p, "", "x") for p in ODD]
    got = found(spark, files)
    assert got == brute(files)
    assert {d for _, s, d, _ in got if s == "run.sh"} >= set(ODD[:4]) and "b.py" not in {d for *_, d, _ in got}


@pytest.mark.parametrize("seed", range(4))
def test_any_path_equals_escaped_patterns(spark, seed):
    rnd = random.Random(seed)
    plain = [f"{d}{n}" for d in ("", "src/", "src/app/", "sub/", "sub/deep/") for n in ("Makefile", "index.ts", "a.py", "page.tsx")]
    paths = [*dict.fromkeys(ODD + rnd.sample(plain, 12))]
    files = []
    for snap in ("s", "t"):
        mine = rnd.sample(paths, 36)
        for source in mine:
            parts = []
            for _ in range(rnd.choice([0, 2, 8])):
                form = rnd.choice(forms_of(source, rnd.choice(mine)))
                form = rnd.choice([form, form, form, "../" + form, "$ROOT/" + form, "x" + form, form + "x", "x/" + form, form[1:], "(" + form + ")", form + "/",
                        "é" + form, form + "é", "./" + form, form + ".", "//" + form, form.replace("/", "/../b/"), form + form])
                parts.append(form + rnd.choice([" ", "", "\n", '"', ", ", "  ", "(", "日"]))
            text = "".join(parts)
            files.append((snap, source, rnd.choice([text, " " + text, None]) if seed else text, "x"))
    assert found(spark, files) == brute(files)


def test_sources_nulls_and_empty_trees(spark):
    files = [("s", "a.sh", "b.py c.py", "x"), ("s", "b.py", "c.py", "x"), ("s", "c.py", None, "x"), ("s", "d.py", "", "x"), (None, "e.py", "b.py", "x")]
    frame = spark.createDataFrame(files, SCHEMA)
    assert {tuple(r)[1:] for r in references.literal_references(frame, F.col("path").endswith(".sh")).collect()} == {("a.sh", "b.py", "b.py"), ("a.sh", "c.py", "c.py")}
    assert references.literal_references(frame.limit(0)).count() == 0
    clash = frame.withColumns({"form": F.lit(1), "src": F.lit(2), "_word": F.lit(3), "kind": F.lit(4)})
    assert references.literal_references(clash).count() == 3


def test_odd_names_are_evidence_of_use(spark):
    files = spark.createDataFrame([
        ("s", ".github/workflows/ci.yml", "run: bash 'tools/build all.sh'", "unknown"), ("s", "tools/build all.sh", "node ./web/[id]/x.js", "unknown"),
        ("s", "tools/web/[id]/x.js", "", "unknown"), ("s", "web/[id]/x.js", "", "unknown"), ("s", "lonely (1).sh", "tools/build all.sh", "unknown"),
    ], SCHEMA)
    got = {(r["source"], r["path"], r["kind"]) for r in references.use(files).collect()}
    assert got == {(".github/workflows/ci.yml", "tools/build all.sh", "static_path_references"),
        ("tools/build all.sh", "web/[id]/x.js", "boundary_path_references"), ("tools/build all.sh", "tools/web/[id]/x.js", "boundary_path_references")}


def test_endings_that_can_mean_no_path_are_not_made(spark):
    """Forms are as deep as the paths that they mean: a word in a deep folder gives few, and every way to name a file is still found."""
    paths = ["a/b/c/d/x.py", "a/b/c/d/y.py", "d/x.py", "x.py", "a/x.py", "a/b/z.py", ".hid/x.py"]
    texts = {"a/b/c/d/y.py": "q/a/b/c/d/x.py ./x.py", "a/b/z.py": "../x.py ./c/d/x.py k/./d/x.py", "x.py": "./a/x.py .hid/x.py ./.hid/x.py", "a/x.py": "b/../x.py b/z.py"}
    files = spark.createDataFrame([("s", p, texts.get(p, "")) for p in paths], "snapshot_id string, path string, text string")
    got = {(r["src"], r["dst"], r["form"]) for r in references.literal_references(files).collect()}
    assert got == {("a/b/c/d/y.py", "a/b/c/d/x.py", "a/b/c/d/x.py"), ("a/b/c/d/y.py", "d/x.py", "d/x.py"), ("a/b/c/d/y.py", "x.py", "./x.py"),
        ("a/b/z.py", "a/x.py", "../x.py"), ("a/b/z.py", "a/b/c/d/x.py", "./c/d/x.py"), ("a/b/z.py", "d/x.py", "./d/x.py"),
        ("x.py", "a/x.py", "./a/x.py"), ("x.py", ".hid/x.py", "./.hid/x.py"), ("a/x.py", "x.py", "../x.py"), ("a/x.py", "a/b/z.py", "b/z.py")}
    texts = files.where("path = 'a/b/c/d/y.py'")
    assert references._plain_forms(texts, files.select("snapshot_id", "path").where("path = 'a/b/c/d/x.py'")).count() == 4
