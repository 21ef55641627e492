"""Evidence of use: files that only imports, only an entry point or only a reference keep active."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_core import git, write

from codemass.operators import references, surfaces, traverse
from codemass.plans import graph_queries, proxies
from codemass.plans import scan as plans
from codemass.sources import trees

TREE = {
    "src/app.py": "import lib.table\n\n\ndef main():\n    return helper()\n\n\ndef helper():\n    return 1\n", "lib/table.py": "ROWS = 3\n",
    "pyproject.toml": '[project]\nname = "x"\n\n[project.scripts]\ntool = "src.app:main"\n', "lonely.py": "Z = 1\n",
    ".github/workflows/ci.yml": "run: ./scripts/go.sh\n", "scripts/go.sh": "python scripts/next.py\n", "scripts/next.py": "X = 1\n",
    "dead_a.sh": "sh dead_b.sh\n", "dead_b.sh": "sh dead_a.sh\n",
}


def test_six_kinds_of_evidence(spark, tmp_path):
    git(tmp_path, "init", "-q")
    write(tmp_path, TREE)
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "one")
    commits = trees.commits(spark, str(tmp_path), "HEAD")
    s = plans.scan_commits(spark, str(tmp_path), commits)
    rows = plans.use_evidence(s).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["path"], set()).add(r["kind"])
    assert "local_dependency_inbound" in kinds["lib/table.py"] and not kinds["lib/table.py"] & {"static_path_references", "boundary_path_references"}
    assert {"capability_surface", "capability_reachable"} <= kinds["src/app.py"] and "capability_surface" in kinds["pyproject.toml"]
    assert kinds["scripts/go.sh"] == {"static_path_references"} and kinds["scripts/next.py"] == {"boundary_path_references"}
    assert not {"lonely.py", "dead_a.sh", "dead_b.sh"} & set(kinds)
    status = {r["path"]: r["status"] for r in plans.metabolise(s, commits).collect()}
    assert {p for p, v in status.items() if v == "active"} == set(kinds)
    reach = {r["name"]: r for r in plans.atlas_reach(s, plans.atlas(s)).collect()}
    assert reach["tool"]["implementation_files"] == ["src/app.py"] and len(reach["tool"]["implementation_symbols"]) >= 2 and not reach["tool"]["truncated"]


def test_reach_is_bounded_nearest_first(spark):
    symbols = spark.createDataFrame([("s", f"n{i}", f"f{i}.py") for i in range(6)], "snapshot_id string, id string, path string")
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}", "calls", "exact", i) for i in range(5)] + [("s", "n1", None, "calls", "unresolved", 9),
            ("s", "n5", "n0", "calls", "probable", 10)],
        "snapshot_id string, source_id string, target_id string, kind string, resolution string, edge_seq long")
    found = spark.createDataFrame([("s", "cli", "a", "f0.py", 1, "n0"), ("s", "cli", "b", "f9.py", 1, None)],
        "snapshot_id string, kind string, name string, path string, line int, symbol_id string")
    reached = surfaces.implementation(found, symbols, edges, max_depth=3, max_symbols=3)
    rows = {r["name"]: r for r in surfaces.with_implementation(found, reached, edges).collect()}
    assert rows["a"]["implementation_symbols"] == ["n0", "n1", "n2"] and rows["a"]["truncated"] and rows["a"]["unresolved_relationships"] == 1
    assert rows["b"]["implementation_files"] == [] and rows["b"]["probable_relationships"] == 0


def test_references_by_accident_do_not_count(spark):
    files = spark.createDataFrame([
        ("s", "Makefile", "run tools/make.py and ../up.py, also mytools/make.py", "unknown"), ("s", "tools/make.py", "", "unknown"),
            ("s", "make.py", "", "unknown"),
        ("s", "up.py", "", "unknown"), ("s", "sub/Makefile", "../up.py ./own.py", "unknown"), ("s", "sub/own.py", "", "unknown"),
    ], "snapshot_id string, path string, text string, category string")
    got = {(r["source"], r["path"]) for r in references.use(files).collect()}
    assert got == {("Makefile", "tools/make.py"), ("sub/Makefile", "up.py"), ("sub/Makefile", "sub/own.py")}
    assert references.use(files).where(F.col("kind") == "boundary_path_references").count() == 0


def test_suppliers_fold_to_five_targets(spark, tmp_path):
    """The edges of all line items of a part go to five parts at most: suppliers are folded, lines are not left out."""
    folder = str(tmp_path)
    spark.range(50).select(F.col("id").alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    lines = [(o, 1, o % 3, o * 7 + 1) for o in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    assert {tuple(r) for r in proxies.frame(spark, folder, "pairs").collect()} == {(p, (p * 7 + s % 5) % 50) for _, _, p, s in lines}


def test_evidence_broadcasts_no_relation_of_a_table(spark, tmp_path, monkeypatch):
    """Relations as long as a table are joined by shuffles, however small its file seems; only names of searches may be broadcast."""
    parts = [(k, f"red bolt {k}", f"Brand#{k % 3}", "STEEL", k + 1) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n, (o * 3 + n) % 40, (o + n) % 5, "ARN"[(o + n) % 3], "O") for o in range(1, 40) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    plans_of, keep = [], references.checkpointed
    seen = lambda df: plans_of.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    monkeypatch.setattr(references, "checkpointed", seen)
    monkeypatch.setattr(traverse, "checkpointed", seen)
    rows = graph_queries.use_evidence(spark, str(tmp_path))
    assert plans_of and not any("BroadcastExchange" in p for p in plans_of)
    assert rows._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1
    assert rows.where("kind = 'static_path_references'").count() > 0
