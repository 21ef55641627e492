"""Operators on small hand-made relations, and whole scans of throw-away trees, commits and archives."""

from __future__ import annotations

import io
import json
import os
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from codemass.functions import scalars, text
from codemass.operators import classify, compare, corpus, layout, metabolism, metrics, references, resolve, surfaces, traverse
from codemass.plans import scan as plans
from codemass.schema import CATEGORIES, COMPONENTS, SYMBOL_EDGES, SYMBOLS
from codemass.sources import parse, records, trees
from codemass.streaming import ingest


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("r")).first()["r"]


def test_lines(spark):
    for s in ("", "a", "a\n", "a\n\nb\r\nc\x0bd\x1ce\x85f g\r", "\n", "a\r\n\r\n"):
        assert list(one(spark, text.lines_of("v"), s)) == s.splitlines(), repr(s)


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("c", "/* head */\nint x;\n", 1), ("c", "/*\n a\n*/ still\nint x; // y\n// z\n", 1), ("shell", "#!/bin/sh\n\nls\n", 1), ("sql", "-- a\nselect 1\n", 1),
        ("html", "<!-- a -->\n<p>\n<!-- b\n-->", 3), ("fsharp", "// a\nlet x = 1", 2), ("php", "# a\n// b\nx", 1), ("markdown", "# a\n\nb", 2),
    ],
)
def test_code_lines(spark, language, source, want):
    row = spark.createDataFrame([(source, language)], "t string, l string").select(text.code_lines(text.lines_of("t"), "l").alias("n")).first()
    assert row["n"] == want


def test_python_lines(spark):
    source = '"""Doc\nmore."""\n# c\nimport x  # d\n\ndef f():\n    """Inner."""\n    return """\n# no comment\n"""\n'
    files = spark.createDataFrame([("python", source, 0), ("c", "x", 1)], "language string, text string, code_lines int")
    got = {r["language"]: r["code_lines"] for r in parse.with_python_lines(files).collect()}
    assert got == {"python": 4, "c": 1}


def test_generated_and_binary(spark):
    mark = lambda s: one(spark, text.looks_generated(text.lines_of("v")), s)
    assert mark("# Auto-generated\nx") and not mark("x = 'do not edit'") and not mark("\n" * 12 + "# do not edit")
    binary = lambda b: one(spark, text.is_binary("v"), bytearray(b), "binary")
    assert binary(b"a\0b") and binary(b"\x01\x02abc") and not binary(b"") and not binary(b"\tplain\r\n" * 50) and not binary(b"\x10" + b"a" * 100)


def test_imports_and_names(spark):
    got = lambda s, g: list(one(spark, text.imports_of("v", F.lit(g)), s))
    assert got("import b.c\nfrom .a import x\n  import b.c", "python") == [".a", "b.c"]
    assert got("const a = require('x')\nimport 'y'\nimport z from \"w\"", "javascript") == ["w", "x", "y"]
    assert got('import "fmt"\n\t"os"\n', "go") == ["os"] and got("use a::b;\nmod c;", "rust") == ["a::b", "c"] and got("x", "lua") == []
    assert one(spark, text.normal_target("v"), " new  Foo::bar(); ") == "Foo.bar" and one(spark, text.normal_target("v"),
        "from x import y") == "from x import y"
    assert sorted(one(spark, text.gram_tokens("v"), "metaAudit_x")) == ["audit", "auditx", "meta", "metaaudit", "metaauditx", "x"]


def test_scalars(spark):
    assert one(spark, scalars.model_of("v"), "0.12.3") == "semantic-v1" and one(spark, scalars.model_of("v"), "0.13.0") is None and one(spark,
        scalars.model_of("v"), "1.3") is None
    assert one(spark, scalars.optional_ratio("v", F.lit(0)), 3, "int") is None and one(spark, scalars.optional_ratio("v", F.lit(0)), 0, "int") == 0.0
    assert one(spark, scalars.rating("v"), 2.5, "double") == "2.5" and one(spark, scalars.rating("v"), 3.0, "double") == "3"
    assert one(spark, scalars.safe_member("v"), "a/b") and not one(spark, scalars.safe_member("v"), "a/../b") and not one(spark,
        scalars.safe_member("v"), "c:b")


def files_of(spark, rows):
    made = spark.createDataFrame([("s", p, g, t) for p, g, t in rows], "snapshot_id string, path string, language string, text string")
    return made.withColumns({"lines_of": text.lines_of("text"), "code_lines": F.lit(10).cast("long"), "lines": F.lit(3),
            "imports": text.imports_of("text", "language")})


def test_classification(spark):
    rows = [("lib/x1.py", "python", "x = 1"), ("src/building.py", "python", "decimal placid"), ("tests/test_a.py", "python", "assert test"),
        (".github/a.yml", "yaml", ""), ("README.md", "markdown", "guide")]
    got = {r["path"]: r for r in classify.classify(files_of(spark, rows)).collect()}
    assert got["lib/x1.py"]["category"] == "unknown" and got["lib/x1.py"]["confidence"] == 0.0 and got["lib/x1.py"]["signals"] == []
    assert got["src/building.py"]["category"] == "core-product" and got["tests/test_a.py"]["category"] == "testing"
    assert got[".github/a.yml"]["category"] == "process-machinery" and got["README.md"]["category"] == "documentation" and got["README.md"][
        "confidence"] <= 0.99
    over = spark.createDataFrame([("./tests", "verification", 0), ("tests/test_a.py", "core-product", 1)], "prefix string, category string, seq int")
    again = {r["path"]: r for r in classify.classify(files_of(spark, rows), over).collect()}
    assert again["tests/test_a.py"]["category"] == "core-product" and again["tests/test_a.py"]["confidence"] == 1.0


def components(spark, rows):
    return spark.createDataFrame([("s", p, "python", n, c, 0.5, None) for p, c, n in rows], COMPONENTS)


def graph(spark, rows):
    return spark.createDataFrame([("s", a, b) for a, b in rows], "snapshot_id string, src string, dst string")


def test_distances_and_chains(spark):
    c = components(spark, [("app", "core-product", 10), ("verify", "verification", 5), ("audit", "audit-provenance", 5),
            ("physics", "essential-support", 5), ("alone", "meta-machinery", 1), ("far", "unknown", 1)])
    g = graph(spark, [("verify", "app"), ("audit", "verify"), ("app", "physics"), ("far", "audit"), ("verify", "audit")])
    got = {r["path"]: r["value_distance"] for r in traverse.value_distances(c, g).collect()}
    assert got == {"app": 0, "verify": 2, "audit": 3, "physics": 1, "alone": 4, "far": 3}
    chains, spent = traverse.audit_chains(c, g)
    assert sorted(map(list, (r["paths"] for r in chains.collect()))) == [["app", "verify"], ["app", "verify", "audit"]]
    assert not spent.first()["truncated"]
    top = traverse.top_chains(chains, c).collect()
    assert [list(r["paths"]) for r in top] == [["app", "verify", "audit"]] and top[0]["total_lines"] == 20
    _, cut = traverse.audit_chains(c, graph(spark, [(f"v{i}", "app") for i in range(20)]).union(g), budget=0)
    assert cut.first()["truncated"]


def symbols(spark, rows):
    return spark.createDataFrame([("s", i, f"{i}.py", "python", k, i, i, 1, 5, None, c) for i, k, c in rows], SYMBOLS)


def links(spark, rows):
    return spark.createDataFrame([("s", n, a, k, b, b, r, "") for n, (a, k, b, r) in enumerate(rows)], SYMBOL_EDGES)


def test_symbol_graph(spark):
    s = symbols(spark, [("core", "function", "core-product"), ("check", "function", "verification"), ("tool", "function", "developer-tooling"),
            ("ledger", "function", "audit-provenance"), ("lost", "function", "testing")])
    e = links(spark, [("check", "calls", "core", "exact"), ("tool", "calls", "check", "exact"), ("ledger", "calls", "tool", "exact"),
            ("lost", "calls", "core", "probable"), ("core", "calls", "core", "exact"), ("check", "calls", "core", "exact")])
    near = {r["id"]: r["value_distance"] for r in traverse.symbol_distances(s, e).collect()}
    assert near == {"core": 0, "check": 1, "tool": 2, "ledger": 3, "lost": None}
    chains, _ = traverse.recursive_chains(s, e)
    assert sorted(list(r["symbol_ids"]) for r in chains.collect()) == [["core", "check"], ["core", "check", "tool", "ledger"]]
    m = metrics.symbol_metrics(traverse.symbol_distances(s, e), e, chains.groupBy("snapshot_id").agg(F.max("depth").alias("max_depth"))).first()
    assert m["max_recursive_depth"] == 3 and m["exact_resolution_rate"] == 5 / 6 and m["resolution_rate"] == 1.0
    none = metrics.symbol_metrics(traverse.symbol_distances(s, e), e.limit(0)).first()
    assert none["exact_resolution_rate"] == 1.0 and none["exact_coverage"] is None


def test_value_paths_stop_at_cycles_and_depth(spark):
    calls = graph(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    root = spark.createDataFrame([("s", "a")], "snapshot_id string, node string")
    paths, spent = traverse.value_paths(calls, root)
    assert [list(r["ids"]) for r in paths.collect()] == [["a", "b", "c", "d"]] and not spent.first()["truncated"]
    short, cut = traverse.value_paths(calls, root, max_depth=2)
    assert [list(r["ids"]) for r in short.collect()] == [["a", "b", "c"]] and cut.first()["truncated"]


def test_resolution_of_imports(spark):
    f = files_of(spark, [("src/pkg/core.py", "python", ""), ("src/pkg/use.py", "python", "from pkg.core import x\nimport json"),
            ("src/on.py", "python", ""), ("other/deep.py", "python", "import a.b.core")])
    got = {(r["src"], r["dst"]) for r in resolve.file_dependencies(f).collect()}
    assert got == {("src/pkg/use.py", "src/pkg/core.py"), ("other/deep.py", "src/pkg/core.py")}


def test_comparison_events(spark):
    a = spark.createDataFrame([("r", 0, 1.0, 0.0, 1), ("r", 1, 0.4, 0.6, 3)],
        "repository string, frame int, product_share double, machinery_share double, recursive_depth int")
    p = spark.createDataFrame([("r", 0, "src", 9, 1), ("r", 1, "src", 4, 6)],
        "repository string, frame int, path string, product_lines long, machinery_lines long")
    got = {(r["type"], r["frame"]) for r in compare.history_events(a, p).collect()}
    assert got == {("repository-dominance-shift", 1), ("recursive-depth-change", 1), ("directory-crossover", 1)}
    before = components(spark, [("old.py", "core-product", 5), ("src/app.py", "core-product", 100), ("same.py", "testing", 4)])
    after = components(spark, [("tests/test_app.py", "testing", 40), ("src/app.py", "verification", 80), ("same.py", "testing", 4)])
    rows = compare.change_drivers(before, after).orderBy("rank").collect()
    assert [(r["path"], r["status"], r["movement"]) for r in rows] == [("src/app.py", "recategorized", 100), ("tests/test_app.py", "added", 40),
        ("old.py", "removed", 5)]


def test_distance_properties(spark):
    zeros = {c: 0.0 for c in CATEGORIES}
    rec = lambda k, code, links, symbols: ("o/" + k, "a" * 40, "2024", 1, "0.10.0", "r", True, None, zeros | code, zeros | symbols, links, 0.5, 2.0,
        10.0, 0.1, None, 0.5, 0.2)
    schema = "repository string, sha string, scanned_at string, seq int, version string, revision string, canonical boolean, model string, category_lines map<string,double>, category_symbols map<string,double>, relationship_count double, exact_resolution_rate double, max_recursive_depth double, semantic_index double, far_share double, scaffolding_ratio double, product_share double, machinery_share double"
    rows = [rec("a", {"core-product": 10.0}, 5.0, {"testing": 3.0}), rec("b", {"core-product": 10.0}, 5.0, {"testing": 3.0}),
        rec("c", {"testing": 9.0}, 0.0, {}), rec("d", {"testing": -1.0}, 0.0, {"unknown": float("nan")})]
    p = corpus.fingerprints(spark.createDataFrame(rows, schema))
    got = {(r["a"], r["b"]): r["d"] for r in corpus.compared(p, p).select(F.col("q.repository").alias("a"), F.col("c.repository").alias("b"), "d").collect()}
    assert got["o/a", "o/b"]["distance"] == 0 and len(got["o/a", "o/b"]["components"]) == 6
    for (x, y), d in got.items():
        assert 0 <= d["distance"] <= 1 and abs(d["distance"] - got[y, x]["distance"]) < 1e-12
        assert abs(sum(c["effective_weight"] for c in d["components"]) - 1) < 1e-12
    assert len(got["o/a", "o/c"]["components"]) == 4 and len(got["o/c", "o/d"]["components"]) == 3
    assert set(got) == {(x, y) for x in ("o/a", "o/b", "o/c", "o/d") for y in ("o/a", "o/b", "o/c", "o/d") if x != y}


def test_treemap_keeps_mass(spark):
    c = components(spark, [("a/x.py", "testing", 30), ("a/b/y.py", "testing", 10), ("z.py", "core-product", 60), ("empty.py", "testing", 0)])
    rows = layout.treemap(c).collect()
    assert sum(r["weight"] for r in rows if r["kind"] == "file") == 100 and {r["path"] for r in rows} == {"a", "a/x.py", "a/b", "a/b/y.py", "z.py"}
    assert all(0 <= r["x"] and r["x"] + r["width"] <= 1000 and 0 <= r["y"] and r["y"] + r["height"] <= 620 for r in rows)


def test_metabolism_ladder(spark):
    rows = [("r", f, p, c, 5, a and f == 0, "x") for f in range(3) for p, c,
        a in (("ops/release_120.py", "developer-tooling", True), ("ops/release_121.py", "developer-tooling", True),
            ("tool.py", "developer-tooling", False), ("docs/legacy.md", "documentation", False), ("x.py", "core-product", False))]
    frames = spark.createDataFrame([*rows, ("r", 2, "now.py", "testing", 1, True, "y")],
        "repository string, frame int, path string, category string, code_lines long, active boolean, print string")
    got = {r["path"]: r["status"] for r in metabolism.status(frames).collect()}
    assert got == {"ops/release_120.py": "superseded-candidate", "ops/release_121.py": "dormant", "tool.py": "bounded-orphan-candidate",
        "docs/legacy.md": "archive-candidate", "x.py": "insufficient-evidence", "now.py": "active"}


def test_references(spark):
    f = spark.createDataFrame([
        ("s", ".github/workflows/go.yml", "run: ./scripts/release.sh", "process-machinery"),
            ("s", "scripts/release.sh", "python $ROOT/scripts/helper.py ../src/post.py", "process-machinery"), ("s", "scripts/helper.py", "", "unknown"),
        ("s", "src/post.py", "", "unknown"), ("s", "dead_a.py", "dead_b.py", "unknown"), ("s", "dead_b.py", "dead_a.py my_helper.py", "unknown"),
            ("s", "helper.py", "", "unknown"),
    ], "snapshot_id string, path string, text string, category string")
    assert {r["path"] for r in references.boundary_use(f).collect()} == {"scripts/release.sh", "scripts/helper.py", "src/post.py"}


def test_surfaces(spark):
    f = files_of(spark, [
        ("app.py", "python", '@app.get("/items")\ndef items():\n    pass\n'),
            ("web.ts", "typescript", "router.post('/x', h)\nexport default function main() {}"), ("C.cs", "csharp", '[HttpGet("a")]\n[HttpPost]'),
        ("pyproject.toml", "toml", '[project.scripts]\ntool = "pkg.cli:main"\n[other]\nx = "a:b"'),
            ("package.json", "json", '{"name": "p", "bin": {"run": ".hidden/run.js"}}'),
    ])
    assert {r["name"] for r in surfaces.routes(f).collect()} == {"GET /items", "POST /x", "GET a", "POST <attribute-route>"}
    assert [(r["name"], r["module"], r["callable"]) for r in surfaces.packaged_scripts(f).collect()] == [("tool", "pkg.cli", "main")]
    assert [r["detail"] for r in surfaces.package_bins(f).collect()] == ["package.json bin -> .hidden/run.js"] and [
        r["name"] for r in surfaces.exports(f).collect()] == ["main"]


def test_journey(spark):
    s = symbols(spark, [("Record", "class", "core-product"), ("normalize", "method", "core-product"), ("save", "method", "core-product"),
            ("helper", "method", "core-product"), ("user", "function", "core-product")])
    e = links(spark, [("Record", "contains", m, "exact") for m in ("normalize", "save", "helper")] + [
            ("user", "calls", t, "exact") for t in ("Record", "normalize", "normalize", "helper")] + [("user", "calls", "save", "probable")])
    types = spark.createDataFrame([("s", "Record")], "snapshot_id string, type_id string")
    stages = {r["role"]: r["events"] for r in surfaces.journey_stages(surfaces.journeys(types, s, e), types).collect()}
    assert stages == {"created": 1, "transformed": 1, "persisted": 0, "emitted": 0}


TREE = {
    "src/app.py": "from lib.physics import resolve\n\n\ndef main():\n    return resolve(1)\n", "lib/physics.py": "def resolve(x):\n    return x\n",
    "verification/verify.py": "from app import main\n\n\ndef verify_app():\n    main()\n",
    "audit/audit_log.py": "from verification.verify import verify_app\n\n\ndef audit_all():\n    verify_app()\n",
    "pkg/__init__.py": "", ".github/workflows/ci.yml": "run: x\n", "broken.py": "def (", "gen.py": "# auto-generated\nx = 1\n",
    "node_modules/x.js": "x", "blob.py": "\0",
}


def write(root, tree):
    for name, body in tree.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


def test_scan_of_a_folder(spark, tmp_path):
    write(tmp_path, TREE)
    s = plans.scan_folder(spark, str(tmp_path))
    paths = {r["path"]: r for r in s.components.collect()}
    assert set(paths) == {"src/app.py", "lib/physics.py", "verification/verify.py", "audit/audit_log.py", "pkg/__init__.py",
        ".github/workflows/ci.yml", "broken.py"}
    deps = {(r["src"], r["dst"]) for r in s.dependencies.collect()}
    assert {("src/app.py", "lib/physics.py"), ("verification/verify.py", "src/app.py"), ("audit/audit_log.py", "verification/verify.py")} <= deps
    calls = {(r["source_id"], r["target_id"]): r["resolution"] for r in s.edges.where("kind = 'calls'").collect()}
    assert calls["src/app.py::main@4", "lib/physics.py::resolve@1"] == "exact"
    assert s.symbol_metrics.first()["max_recursive_depth"] >= 2 and any("parse failed" in r["message"] for r in s.diagnostics.collect())
    assert s.metrics.first()["total_lines"] > 0
    assert plans.atlas(s).count() == 0


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_history_of_commits(spark, tmp_path):
    git(tmp_path, "init", "-q")
    write(tmp_path, {"src/app.py": "def main():\n    pass\n" * 10})
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    write(tmp_path, {"tests/test_app.py": "def test_main():\n    assert 1\n" * 30})
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "two")
    commits = trees.commits(spark, str(tmp_path), "HEAD")
    assert [r["subject"] for r in commits.orderBy("frame").collect()] == ["one",
        "two"] and trees.static_sha(str(tmp_path)) == commits.orderBy(F.desc("frame")).first()["sha"]
    with pytest.raises(trees.TreeError, match="invalid-limit"):
        trees.commits(spark, str(tmp_path), "HEAD", limit=0)
    s = plans.scan_commits(spark, str(tmp_path), commits)
    points, events = plans.history(s, commits)
    assert points.count() == 2 and {r["type"] for r in events.collect()} == {"repository-dominance-shift"}
    _, changes = plans.movie(s, commits)
    assert [(r["frame"], r["path"], r["appeared"]) for r in changes.collect()] == [(1, "tests/test_app.py", True)]
    assert {r["path"] for r in plans.metabolise(s, commits).collect()} == {"src/app.py", "tests/test_app.py"}


def tarball(items):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body, kind in items:
            m = tarfile.TarInfo(name)
            m.type, m.size = kind, len(body or b"")
            t.addfile(m, io.BytesIO(body or b""))
    return out.getvalue()


def test_archives_fail_closed(spark, tmp_path):
    good = tarball([("r", None, tarfile.DIRTYPE), ("r/.github/a.yml", b"x: 1", tarfile.REGTYPE), ("r/a.py", b"x", tarfile.REGTYPE)])
    (tmp_path / "a.tar.gz").write_bytes(good)
    trees.register(spark)
    rows = spark.read.format("source_tarball").option("path", str(tmp_path / "a.tar.gz")).load().collect()
    assert {r["path"] for r in rows} == {".github/a.yml", "a.py"}
    for items, code in (
        ([("r/../x", b"", tarfile.REGTYPE)], "unsafe"), ([("r/l", None, tarfile.SYMTYPE)], "unsafe"),
        ([("r/a", b"", tarfile.REGTYPE), ("q/b", b"", tarfile.REGTYPE)], "unsafe"),
        ([("r/a", b"", tarfile.REGTYPE)] * 2, "unsafe"), ([("/r/a", b"", tarfile.REGTYPE)], "unsafe"),
    ):
        with pytest.raises(trees.TreeError, match=code):
            list(trees.members(tarball(items), strict=True))
    with pytest.raises(trees.TreeError, match="extracted-too-large"):
        list(trees.members(good, strict=True, max_bytes=3))
    with pytest.raises(trees.TreeError, match="invalid-archive"):
        list(trees.members(b"junk", strict=True))


def test_records(spark, tmp_path):
    row = {"status": "ok", "scanned_at": "2024-01-01T00:00:00Z", "identity": "i", "repository": {"name": "o/r", "sha": "a"},
        "analyzer": {"version": "0.10.0"}, "measurement": {"category_code_lines": {"testing": 3}, "baseline": {}, "semantic": {}}}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"status": "failed"}) + "\n")
    read = records.corpus(spark, str(tmp_path / "c.jsonl"))
    assert read.count() == 2 and corpus.fingerprints(records.flat(read)).first()["code_total"] == 3
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="not a JSON record"):
        records.corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    assert [tuple(r) for r in records.manifest(spark, '{"targets": ["o/r", {"repo": "a/b", "sha": "' + "c" * 40 + '", "x": 1}]}').collect()] == [
        (0, "o/r", None), (1, "a/b", "c" * 40)]
    with pytest.raises(ValueError, match="target 0"):
        records.manifest(spark, '["nothing"]')
    with pytest.raises(ValueError, match="unknown categories"):
        records.config(spark, '{"paths": {"x": ["a"]}}')
    records.write_json(spark.sql("select 1 as b, 2.5D as a"), str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == {"a": 2.5, "b": 1}


def test_streaming_intake(spark, tmp_path):
    rows = [{"status": s, "scanned_at": "2024-01-01T00:00:00Z", "identity": i} for s, i in (("ok", "a"), ("ok", "a"), ("failed", "b"), ("ok", "c"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.start(ingest.records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "chk"))
    q.awaitTermination(120)
    assert sorted(r["identity"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_corpus_targets(spark):
    t = spark.createDataFrame([("O/r", None, 0), ("o/R", None, 1), ("a/b", "x", 2)], "repository string, sha string, seq int")
    assert {r["seq"] for r in corpus.distinct_targets(t).collect()} == {0, 2}
    clash = spark.createDataFrame([("a/b", "1"), ("A/b", "2")], "repository string, sha string")
    with pytest.raises(Exception, match="conflicting"):
        corpus.with_overrides(t, clash).collect()
