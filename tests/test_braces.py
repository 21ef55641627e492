"""Symbols of brace languages: spans, nesting, calls, and texts that mislead."""

from __future__ import annotations

import random

import pytest

from codemass.plans import source_queries
from codemass.sources import braces, parse

SCHEMA = "snapshot_id string, path string, language string, text string, lines int"


def rows_of(spark, sources: list[tuple]) -> list:
    files = [("s", path, language, text, (text or "").count("\n") + 1) for path, language, text in sources]
    return parse.parsed(spark.createDataFrame(files, SCHEMA).repartition(2)).collect()


def symbols(rows) -> dict:
    return {(r["path"], r["qualified_name"], r["start_line"], r["end_line"]): r["kind"] for r in rows if r["row"] == "symbol" and r["kind"] != "file"}


def edges(rows, kind: str) -> set:
    return {(r["path"], r["id"].split("::", 1)[1].split("@")[0], r["target_name"]) for r in rows if r["row"] == "edge" and r["kind"] == kind}


def test_major_languages_have_symbols(spark):
    samples = {
        "javascript": "function run() { helper(); } function helper() {}",
        "typescript": "class App { run(): void { helper(); } } function helper(): void {}",
        "java": "class App { void run() { helper(); } void helper() {} }",
        "go": "package main\nfunc run(){ helper() }\nfunc helper(){}",
        "rust": "fn run(){ helper(); } fn helper(){}",
        "cpp": "void helper(){} void run(){ helper(); }",
        "c": "static void helper(void){} int run(void){ helper(); return 0; }",
        "csharp": "public class App {\n public void run() { helper(); }\n void helper() { } }",
    }
    rows = rows_of(spark, [(f"x.{k}", k, v) for k, v in samples.items()])
    for k in samples:
        names = {q.split(".")[-1] for p, q, *_ in symbols(rows) if p == f"x.{k}"}
        assert {"run", "helper"} <= names, k
        assert any(t == "helper" and "run" in source for p, source, t in edges(rows, "calls") if p == f"x.{k}"), k
    assert not [r for r in rows if r["row"] == "diagnostic"]


def test_strings_comments_and_directives_hold_no_code(spark):
    rows = rows_of(spark, [
        ("a.js", "javascript", "// function no() {\nconst r = /[{(]\\//g, t = `function no() { ${x} {`;\nfunction yes({a}, b = ')') { /* } */ go(\"(\") }\nclass K {\n  static async m() { return n().o(1) }\n}\n"),
        ("a.rs", "rust", "fn f<'a>(x: &'a str) { let c = '{'; let r = r#\"fn no() { \" {\"#; g(c) }\n#[derive(Debug)]\nstruct S(i32);\ntrait T { fn sig(&self); }\n"),
        ("a.go", "go", "package p\nimport (\n\t\"fmt\"\n)\nvar s = `func no() {`\nfunc (t *T) M(a int,\n\tb int) error {\n\treturn fmt.Errorf(\"}\", '}')\n}\n"),
        ("a.c", "c", "#include <x.h>\n#define NO(a) if (a) { \\\n  (\nint proto(int);\nstatic int\nlong_one(int a)\n{\n  if (a) { use('}'); } else if (b(a)) { }\n}\nstruct P { int a; };\n"),
        ("A.java", "java", "import a.B;\n/* { */\nclass A<T> extends B<T> implements I, J<K> {\n  String t = \"\"\"\n    class No {\n    \"\"\";\n  A() { super(); }\n  <U> List<U> m(int[] a) throws E { return new X().go(a); }\n  abstract void n();\n}\n"),
    ])
    assert symbols(rows) == {
        ("a.js", "yes", 3, 3): "function", ("a.js", "K", 4, 6): "class", ("a.js", "K.m", 5, 5): "method",
        ("a.rs", "f", 1, 1): "function", ("a.rs", "S", 3, 3): "struct", ("a.rs", "T", 4, 4): "trait", ("a.rs", "T.sig", 4, 4): "function",
        ("a.go", "M", 6, 9): "method", ("a.c", "long_one", 5, 9): "function", ("a.c", "P", 10, 10): "struct",
        ("A.java", "A", 3, 10): "class", ("A.java", "A.A", 7, 7): "constructor", ("A.java", "A.m", 8, 8): "method", ("A.java", "A.n", 9, 9): "method",
    }
    assert edges(rows, "calls") == {
        ("a.js", "yes", "go"), ("a.js", "K.m", "n"), ("a.js", "K.m", "().o"), ("a.rs", "f", "g"), ("a.go", "M", "fmt.Errorf"), ("a.c", "long_one", "use"),
        ("a.c", "long_one", "b"), ("A.java", "A.m", "go"),
    }
    assert {(p, t) for p, _, t in edges(rows, "imports")} == {("a.go", 'import ( "fmt" )'), ("a.c", "#include <x.h>"), ("A.java", "import a.B")}
    assert edges(rows, "inherits") == {("A.java", "A", "B")} and edges(rows, "implements") == {("A.java", "A", "I"), ("A.java", "A", "J")}
    assert not [r for r in rows if r["row"] == "diagnostic"]


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_spans_are_exact(spark, seed):
    """Random nests of classes, methods, blocks and calls, with what is expected noted while they are written."""
    rnd = random.Random(seed)
    want, calls, out = {}, set(), []
    numbers = iter(range(10_000))

    def noise() -> str:
        return rnd.choice(["", "// } {\n", '"(";\n', "/* {\n ) */\n", "\n\n", "x = { a: [1, (2)] };\n", "if (a) { b; }\n"])

    def block(path: str, scope: str, depth: int, in_class: bool) -> None:
        for _ in range(rnd.randint(1, 3)):
            n = next(numbers)
            start = "".join(out).count("\n") + 1
            kind = rnd.choice(["class", "member" if in_class else "function"] + ([] if in_class else ["call", "loop"]))
            if kind == "call":
                out.append(f"c{n}(1, (2));\n")
                calls.add((path, scope or "<file>", f"c{n}"))
                continue
            if in_class and kind == "class":
                kind = "member"
            if depth > 4:
                continue
            name = f"n{n}"
            inner = f"{scope}.{name}".strip(".") if kind != "loop" else scope
            out.append({"class": f"class {name} {{\n", "member": f"  {name}(a, {{b}}) {{\n", "function": f"function {name}(a = (1)) {{", "loop": "for (;;) {\n"}[kind])
            out.append(noise() if kind != "class" else "")
            block(path, inner, depth + 1, kind == "class")
            out.append("}\n")
            if kind != "loop":
                want[(path, inner, start, "".join(out).count("\n"))] = {"class": "class", "member": "method", "function": "function"}[kind]

    sources = []
    for i in range(12):
        out.clear()
        block(f"f{i}.ts", "", 0, False)
        sources.append((f"f{i}.ts", "typescript", "".join(out)))
    rows = rows_of(spark, sources)
    assert symbols(rows) == want and edges(rows, "calls") == calls
    parents = {r["id"]: r["parent_id"] for r in rows if r["row"] == "symbol"}
    for r in rows:
        if r["row"] == "symbol" and "." in (r["qualified_name"] or "") and r["kind"] != "file":
            assert parents[r["id"]].split("::")[1].split("@")[0] == r["qualified_name"].rsplit(".", 1)[0]


def test_nulls_empties_and_broken_texts(spark):
    rows = rows_of(spark, [("a.go", "go", None), ("b.go", "go", ""), ("c.go", "go", "func f() {\n if x {\n"), ("d.go", "go", "}}\nfunc g() {}\n"), ("e.go", "go", '"' * 9),
        ("f.lua", "lua", "x"), ("g.txt", "text", "func f() {}")])
    assert symbols(rows) == {("c.go", "f", 1, 3): "function", ("d.go", "g", 2, 2): "function"}
    assert {(r["path"], r["message"]) for r in rows if r["row"] == "diagnostic"} == {
        ("c.go", "brackets do not match; partial graph retained"), ("d.go", "brackets do not match; partial graph retained"),
        ("f.lua", "tree-sitter parser unavailable"), ("g.txt", "no parser for text"),
    }
    assert {r["path"] for r in rows if r["kind"] == "file"} == {"a.go", "b.go", "c.go", "d.go", "e.go", "f.lua"}
    assert braces.rows_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_are_not_written_and_deep_names_are_whole(spark, monkeypatch):
    written, keep = [], braces.checkpointed
    monkeypatch.setattr(braces, "checkpointed", lambda df: written.append(df.columns) or keep(df))
    flat = ("a.java", "java", "class A {\n  void m() { f(); }\n}\n")
    rows = rows_of(spark, [flat])
    assert ("a.java", "A.m", 2, 2) in symbols(rows) and edges(rows, "calls") == {("a.java", "A.m", "f")}
    assert len(written) == 1 and "text" not in written[0]
    deep = "".join(f"class C{i} {{\n" for i in range(5)) + "void m() { f(); }\n" + "}\n" * 5
    rows = rows_of(spark, [flat, ("b.java", "java", deep), ("c.java", "java", "class A { class B { void n() { g(); } } ")])
    assert ("b.java", "C0.C1.C2.C3.C4.m", 6, 6) in symbols(rows) and ("c.java", "A.B.n", 1, 1) in symbols(rows)
    assert edges(rows, "calls") == {("a.java", "A.m", "f"), ("b.java", "C0.C1.C2.C3.C4.m", "f"), ("c.java", "A.B.n", "g")}
    assert [r["path"] for r in rows if r["row"] == "diagnostic"] == ["c.java"]


def test_includes_of_cpp_are_imports(spark):
    rows = rows_of(spark, [("a.cpp", "cpp", '#include <x.h>\n#  include "y.h"\nvoid f() { g(); }\n')])
    assert {t for _, _, t in edges(rows, "imports")} == {"#include <x.h>", '# include "y.h"'} and edges(rows, "calls") == {("a.cpp", "f", "g")}


def test_outlines_are_the_rows_and_meet_no_other_file(spark, tmp_path):
    """Symbols with their calls come out of the walk, so the query shuffles numbers of lines once and writes nothing."""
    sources = [("s", "a.java", "java", "class A { void m() { g(); f(); h(f()); } int m() { return 1; } }", 1), ("s", "b.go", "go", None, 0),
        ("s", "c.ts", "typescript", "function a() {\n function b() { c(1);\n }\n}", 4), ("s", "d.lua", "lua", "f()", 1)]
    files = spark.createDataFrame(sources, SCHEMA)
    got = {(r["path"], r["qualified_name"], r["start_line"], r["end_line"], r["kind"], r["calls"], r["first_call"]) for r in braces.outlines(files).collect()}
    assert got == {("a.java", "A", 1, 1, "class", 0, None), ("a.java", "A.m", 1, 1, "method", 4, "f"), ("c.ts", "a", 1, 4, "function", 0, None), ("c.ts", "a.b", 2, 3, "function", 1, "c")}
    spark.createDataFrame([(o, n, o * n) for o in range(1, 9) for n in (1, 2)], "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = source_queries.brace_symbols(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "ExistingRDD" not in plan
    assert df.count() == 16 + 6
