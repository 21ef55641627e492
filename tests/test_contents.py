"""Scans of many commits by content: equal to whole archives, and each content read and parsed once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_core import git, write

from codemass.plans import scan as plans
from codemass.sources import parse, trees

BODY = "import lib.util\n\n\ndef main():\n    return helper()\n\n\ndef helper():\n    return {}\n"


def history(root) -> None:
    """Commits that change, remove, bring back, copy and move files, change modes, and touch what is not read."""
    steps = [
        {"src/app.py": BODY.format(1), "lib/util.py": "A = 1\n", "web/x.ts": "export class K { m() { go(); } }\n", "big.bin": "\0" * 9, "né.py": "X = 1\n"},
        {"src/app.py": BODY.format(2), "tests/test_app.py": "def test_main():\n    assert 1\n"},
        {"lib/util.py": None, "audit/verify.py": "import src.app\n\n\ndef verify():\n    return 1\n"},
        {"lib/util.py": "A = 1\n", "copy/util.py": "A = 1\n", "node_modules/x.py": "B = 1\n", "README.txt": "no"},
        {"src/app.py": BODY.format(1), "copy/util.py": None, "moved/util.py": "A = 1\n"},
    ]
    git(root, "init", "-q")
    for n, step in enumerate(steps):
        write(root, {k: v for k, v in step.items() if v is not None})
        for k, v in step.items():
            if v is None:
                os.remove(root / k)
        if n == 1:
            os.symlink("app.py", root / "src/link.py")
            os.chmod(root / "web/x.ts", 0o755)
        if n == 3:
            os.remove(root / "src/link.py")
            write(root, {"src/link.py": "L = 1\n"})
        git(root, "add", "-A")
        git(root, "commit", "-qm", str(n))


def told(df, drop: tuple = ()) -> set:
    return {tuple(map(str, r)) for r in df.select(*sorted(set(df.columns) - set(drop))).collect()}


def test_contents_give_the_whole_scan(spark, tmp_path, monkeypatch):
    history(tmp_path)
    commits = trees.commits(spark, str(tmp_path), "HEAD")
    seen = []
    whole_parse = parse.parsed
    monkeypatch.setattr(parse, "parsed", lambda files: seen.append(files.count()) or whole_parse(files))
    got = plans.scan_commits(spark, str(tmp_path), commits)
    shas = ",".join(r["sha"] for r in commits.collect())
    want = plans.scan(spark.read.format("git_tree").option("path", str(tmp_path)).option("commits", shas).load())
    assert got.contents is not None and want.contents is None
    for part in ("files", "components", "dependencies", "metrics", "profiles", "symbols", "diagnostics", "symbol_metrics"):
        assert told(getattr(got, part)) == told(getattr(want, part)), part
    assert told(got.edges, ("edge_seq",)) == told(want.edges, ("edge_seq",))
    # by content: app.py twice, verify, test, x.ts, né.py, link.py, and util.py at three paths
    assert seen == [10, want.files.count()] and seen[1] > 25
    # the print of a file takes its size, lines and category in, not its text alone
    none = got.files.select("snapshot_id", "path").limit(0)
    before = {r["path"]: r for r in plans.metabolise(got, commits, none).collect()}
    first = commits.orderBy("frame").first()["sha"]
    got.components = got.components.withColumn("category", F.when((F.col("snapshot_id") == first) & (F.col("path") == "né.py"), "testing").otherwise(F.col("category")))
    after = {r["path"]: r for r in plans.metabolise(got, commits, none).collect()}
    assert before["né.py"] != after["né.py"] and before["lib/util.py"] == after["lib/util.py"]


def test_runs_stand_without_a_break(spark, tmp_path):
    history(tmp_path)
    shas = [r["sha"] for r in trees.commits(spark, str(tmp_path), "HEAD").orderBy("frame").collect()]
    runs = {(r["path"], r["first"], r["last"]) for r in trees.commit_runs(spark, str(tmp_path), shas).collect()}
    assert {r for r in runs if r[0] == "lib/util.py"} == {("lib/util.py", 0, 1), ("lib/util.py", 3, 4)}
    assert {r for r in runs if r[0] == "src/app.py"} == {("src/app.py", 0, 0), ("src/app.py", 1, 3), ("src/app.py", 4, 4)}
    assert {r for r in runs if r[0] == "src/link.py"} == {("src/link.py", 3, 4)} and ("né.py", 0, 4) in runs
    assert not any(r[0].startswith(("node_modules", "big", "README.txt")) for r in runs if r[0] != "README.txt")
    with pytest.raises(Exception, match="git-error"):
        trees.commit_runs(spark, str(tmp_path), ["0" * 40]).collect()


def test_attributes_are_kept_to(spark, tmp_path):
    write(tmp_path, {"src/app.py": "A = 1\n", "secret/x.py": "B = 1\n", ".gitattributes": "secret export-ignore\n"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    s = plans.scan_commits(spark, str(tmp_path), trees.commits(spark, str(tmp_path), "HEAD"), symbols=False)
    assert {r["path"] for r in s.components.collect()} == {"src/app.py"} and s.contents is None

