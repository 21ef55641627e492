"""Selectors, atlas, journeys, records, reports and the command line on throw-away trees; the registered queries' SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_core import git, symbols, tarball, write

import __spark_entry__
from codemass import __main__ as cli
from codemass.operators import classify, select, surfaces
from codemass.plans import catalogue, reports, scan
from codemass.schema import SYMBOLS
from codemass.sources import records

TREE = {
    "src/cli.py": '__all__ = ["main"]\n\n\ndef main():\n    work()\n\n\ndef work():\n    return Record()\n\n\nclass Record:\n    def save(self):\n        pass\n\n\nif __name__ == "__main__":\n    main()\n',
    "src/web.py": '@app.get("/items")\ndef items():\n    pass\n', "pyproject.toml": '[project.scripts]\ntool = "cli:main"\n',
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    write(folder, TREE)
    return folder, scan.scan_folder(spark, str(folder))


def test_atlas_and_value_path(spark, scanned):
    _, s = scanned
    found = scan.atlas(s)
    names = {(r["kind"], r["name"]): r["symbol_id"] for r in found.collect()}
    assert names["cli", "tool"] == "src/cli.py::main@4" and names["http-route", "GET /items"] == "src/web.py::items@2"
    assert names["entrypoint", "cli"] == names["public-api", "main"] == "src/cli.py::main@4"
    best = scan.value_path(s, found, "tool").where("rank = 1").first()
    assert list(best["ids"]) == ["src/cli.py::main@4", "src/cli.py::work@8", "src/cli.py::Record@12"]
    with pytest.raises(select.SelectionError, match="nothing matches"):
        scan.value_path(s, found, "absent")
    with pytest.raises(select.SelectionError, match="choose one"):
        scan.value_path(s, found, None)


def test_data_journey(spark, scanned):
    _, s = scanned
    found = scan.data_journey(s, "record")
    assert [(r["role"], r["source_id"], r["trust"]) for r in found["events"].collect()] == [("created", "src/cli.py::work@8", "exact-call-to-data-type")]
    assert {r["role"]: r["events"] for r in found["stages"].collect()} == {"created": 1, "transformed": 0, "persisted": 0, "emitted": 0}
    assert found["warnings"].count() == 2
    idle = found["boundaries"].collect()
    assert idle and not any(r["called"] for r in idle) and idle[0]["evidence"].startswith("exact member containment; lifecycle verb")
    exact = s.edges.where("kind = 'calls' and resolution = 'exact' and target_id is not null").count()
    assert [r["exact_calls_examined"] for r in found["examined"].collect()] == [exact]


def test_selector_tiers(spark):
    s = symbols(spark, [("Order", "class", "unknown"), ("OrderLine", "class", "unknown"), ("order", "struct", "unknown"), ("x", "function", "unknown")])
    assert select.data_symbol(s, "OrderL").first()["id"] == "OrderLine"
    with pytest.raises(select.SelectionError, match="ambiguous"):
        select.data_symbol(s, "ORDER")
    with pytest.raises(select.SelectionError, match="nothing"):
        select.data_symbol(s, "x")


def test_declared_surfaces(spark):
    rows = [("s", "a", "A.java", "java", "class", "A", "A", 1, 2, None, "core-product"),
        ("s", "g", "m.go", "go", "function", "Run", "Run", 1, 1, "m.go::<file>", "core-product"),
        ("s", "h", "m.go", "go", "function", "run", "run", 2, 2, None, "core-product")]
    s = spark.createDataFrame(rows, SYMBOLS).withColumns({"role_confidence": F.lit(0.9), "role_source": F.lit("x")})
    files = spark.createDataFrame([("s", "A.java", "public class A {\n}"), ("s", "m.go", "func Run() {}\nfunc run() {}")],
        "snapshot_id string, path string, text string")
    none = spark.createDataFrame([], "snapshot_id string, symbol_id string")
    assert {r["name"] for r in surfaces.declared_surfaces(files, s, none).collect()} == {"A"}
    assert {r["name"] for r in surfaces.declared_surfaces(files, s, none, top_level="file_parent").collect()} == {"A", "Run"}


def test_symbol_roles(spark):
    def role(path, name, category, body="", kind="function"):
        s = spark.createDataFrame([("s", "i", path, "python", kind, name, name, 1, 1, None, category)], SYMBOLS)
        f = spark.createDataFrame([("s", path, [body])], "snapshot_id string, path string, lines_of array<string>")
        r = classify.refine_symbols(s, f).first()
        return r["category"], r["role_source"], round(r["role_confidence"], 2)

    assert role("tests/a.py", "x", "core-product") == ("testing", "strong-path-role", 0.98)
    assert role("src/a.py", "verify", "core-product") == ("core-product", "file-seed-preserved", 0.72)
    assert role("x/a.py", "verify", "verification") == ("verification", "symbol-local-machinery-evidence", 0.88)
    assert role("x/a.py", "images", "verification") == ("essential-support", "mixed-file-context-fallback", 0.62)
    assert role("src/a.py", "images", "verification") == ("core-product", "mixed-file-context-fallback", 0.68)
    assert role("lib/a.py", "open_menu", "unknown") == ("user-surface", "symbol-local-product-evidence", 0.86)
    assert role("lib/a.py", "a.py", "testing", kind="file") == ("testing", "file-classification", 1.0)


def test_symbol_roles_cut_words_once(spark):
    """Each text of a symbol is cut into tokens once, whatever reads them: name, qualified name, body, path and folder."""
    s = spark.createDataFrame([("s", "i", "src/a.py", "python", "function", "x", "x", 1, 1, None, "testing")], SYMBOLS)
    f = spark.createDataFrame([("s", "src/a.py", ["x"])], "snapshot_id string, path string, lines_of array<string>")
    plan = classify.refine_symbols(s, f)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") <= 5 * 9


def test_index_run(spark, tmp_path):
    import tarfile

    reg = tarfile.REGTYPE
    (tmp_path / "o__good.tar.gz").write_bytes(tarball([("r", None, tarfile.DIRTYPE), ("r/src/a.py", b"def f():\n    pass\n", reg)]))
    (tmp_path / "o__bad.tar.gz").write_bytes(tarball([("r/../a.py", b"", reg)]))
    manifest = tmp_path / "m.json"
    manifest.write_text('["o/good", {"repo": "o/bad"}, "O/Good", "o/absent"]')
    args = ["index", str(manifest), f"file://{tmp_path}/corpus", "--tarballs", str(tmp_path)]
    assert cli.main(args, spark) == 1
    rows = {r["repository"]["name"]: r for r in records.corpus(spark, f"file://{tmp_path}/corpus").collect()}
    assert rows["o/good"]["status"] == "ok" and rows["o/good"]["measurement"]["category_symbol_counts"] and rows["o/bad"]["reason"][
        "code"] == "unsafe-archive" and rows["o/absent"]["status"] == "failed"
    assert cli.main(args, spark) == 1 and records.corpus(spark, f"file://{tmp_path}/corpus").where("status = 'ok'").count() == 1
    assert cli.main(["context", f"file://{tmp_path}/corpus", "--repo", "O/GOOD"], spark) == 0


def test_command_line(spark, scanned, tmp_path, capsys):
    folder, _ = scanned
    assert cli.main(["scan", str(folder), "--rating-only"], spark) == 0 and "recursion_index" in capsys.readouterr().out
    report = tmp_path / "r.html"
    assert cli.main(["atlas", str(folder), "--report", str(report)], spark) == 0 and "GET /items" in report.read_text()
    assert cli.main(["journey", str(folder), "--data", "absent"], spark) == 2
    assert cli.main(["history", str(tmp_path)], spark) == 2
    git(folder, "init", "-q")
    git(folder, "add", ".")
    git(folder, "commit", "-qm", "one")
    assert cli.main(["movie", str(folder)], spark) == 0


def test_reports_escape(spark):
    page = reports.page("<t>", [("a&b", spark.createDataFrame([("<script>", None)] * 3, "x string, y int"))], rows=2)
    assert "<script>" not in page and "&lt;script&gt;" in page and "first 2 rows" in page and "http" not in page


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", ["composition_metrics", "directory_profiles", "value_distance", "resolve_names", "neighbours_topk",
        "context_percentiles", "history_events", "metabolism_status", "code_lines", "literal_references"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SMALL):
        if t.endswith(".parquet"):
            db.execute(f"create view {t[:-8]} as select * from '{SMALL}/{t}'")
    df = catalogue.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(repr, db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalogue.oracle_sql()[name]})").fetchall()))
    assert got == want and got


def test_entry(spark):
    if os.path.isdir(SMALL):
        assert __spark_entry__.entry(spark).count() == 1
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and all(map(callable, known.values()))


