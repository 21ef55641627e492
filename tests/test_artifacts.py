"""Saved scans, comparisons of them, change drivers of two commits, and stories."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_core import git, write

from codemass import __main__ as command
from codemass.operators import compare
from codemass.plans import artifacts
from codemass.sources import trees


def test_two_commits_compared_saved_and_told(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    write(repo, {"src/app.py": "def main():\n    return 1\n" * 20, "ops/run.py": "x = 1\n"})
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "one")
    at = lambda name: str(tmp_path / name)
    assert command.main(["scan", str(repo), "--json", at("first")], spark) == 0
    write(repo, {"tests/test_app.py": "def test_main():\n    assert 1\n" * 30, "src/app.py": "def main():\n    return 1\n" * 5})
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "two")
    assert command.main(["scan", str(repo), "--json", at("second")], spark) == 0
    assert command.main(["compare", at("first"), at("second"), "--json", at("delta")], spark) == 0
    saved = {r["category"]: r["delta"] for r in spark.read.json(at("delta") + "/categories").collect()}
    assert saved["testing"] == 60
    assert command.main(["drivers", str(repo), "--before", "HEAD~1", "--json", at("drivers")], spark) == 0
    direct, sha = artifacts.scan_two(spark, str(repo), "HEAD~1", "HEAD", version="1", source="x")
    assert {r["category"]: r["delta"] for r in direct["categories"].collect()} == saved
    assert direct["files"].orderBy("rank").first()["path"] == "tests/test_app.py" and direct["identity"].first()["like_for_like"]
    assert "Testing gained 60 LOC." in [r["message"] for r in direct["explanations"].collect()]
    assert sha == trees.static_sha(str(repo)) == artifacts.head(spark, at("drivers"), "drivers")["repository_sha"]
    assert command.main(["story", at("second"), "--drivers", at("drivers")], spark) == 0
    told = artifacts.story(spark, at("second"), drivers=at("drivers"))["story"].first()
    assert told["drivers_matches"] and not told["comparison_matches"]
    late = artifacts.story(spark, at("first"), drivers=at("drivers"))["story"].first()
    # drivers of another commit are a historical change point, no fault
    assert not late["drivers_matches"] and late["driver_relation"] == "historical-change-point" and late["warnings"] == []
    assert command.main(["story", at("drivers")], spark) == 2 and "expected 'codemass-scan'" in capsys.readouterr().err


def test_broken_artifacts_are_named(spark, tmp_path):
    with pytest.raises(artifacts.ArtifactError, match="could not read"):
        artifacts.head(spark, str(tmp_path / "none"), "scan")
    for k, (text, why) in enumerate([("{", "no valid JSON"), ("[]", "one JSON object"),
            ('{"schema": "codemass-history/1"}', "schema 'codemass-history'"), ("{}", "schema 'missing'"),
        (json.dumps({"schema": {"name": "codemass-scan"}, "repository_sha": "abc"}), "no full commit hash")]):
        (tmp_path / f"{k}" / "head").mkdir(parents=True)
        (tmp_path / f"{k}" / "head" / "part.txt").write_text(text)
        with pytest.raises(artifacts.ArtifactError, match=why):
            artifacts.head(spark, str(tmp_path / f"{k}"), "scan")
    with pytest.raises(Exception, match="not finite"):
        artifacts.save(spark, str(tmp_path / "nan"), "scan", None, {"m": spark.range(1).select(F.lit(float("nan")).alias("x"))})


def test_git_guards(spark, tmp_path, monkeypatch):
    with pytest.raises(trees.TreeError, match="repository-missing"):
        trees.repository_root(str(tmp_path / "none"))
    with pytest.raises(trees.TreeError, match="git-error"):
        trees.repository_root(str(tmp_path))
    monkeypatch.setattr(trees, "MIN_GIT", (99, 0))
    with pytest.raises(trees.TreeError, match="git-version"):
        trees.repository_root(str(tmp_path))


def test_explanations_in_words(spark):
    deltas = spark.createDataFrame([("testing", 0, 1200, 1200), ("core-product", 5, 2, -3), ("unknown", 1, 1, 0)],
        "category string, before long, after long, delta long")
    crossed = spark.createDataFrame([("b",), ("a",)], "path string")
    depth = spark.createDataFrame([(1, 3)], "before int, after int")
    chains = spark.createDataFrame([("added", None, "x -> z"), ("added", None, "x -> y"), ("removed", "q -> r", None), ("changed", "a", "b")],
        "change string, before string, after string")
    rows = compare.structural_explanations(deltas, crossed, depth, chains).orderBy("part", "rank").collect()
    assert [r["message"] for r in rows] == [
        "Testing gained 1,200 LOC.", "Core Product lost 3 LOC.", "a crossed from product-dominant to machinery-dominant.",
        "b crossed from product-dominant to machinery-dominant.",
        "Max exact recursive depth increased from 1 to 3.", "A new deepest exact machinery chain appeared through x -> y.",
        "A previously deepest exact machinery chain disappeared: q -> r.",
        "A deepest exact chain kept the same endpoints but changed its internal structural path.",
    ]


def test_a_story_warns_of_known_commits_alone(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    empty = {k: spark.createDataFrame([], schema) for k, schema in artifacts.SCAN.items()}
    one, two = "a" * 40, "b" * 40
    artifacts.save(spark, at("scan"), "scan", one, empty)
    artifacts.save(spark, at("nameless"), "scan", None, empty)
    crossed = spark.createDataFrame([], "path string, before double, nested struct<a: int>")
    artifacts.save(spark, at("drivers"), "drivers", two, {"crossovers": crossed})
    artifacts.save(spark, at("context"), "context", two, {"context": spark.createDataFrame([(1,)], "n int")})
    artifacts.save(spark, at("unknown"), "context", None, {"context": spark.createDataFrame([(1,)], "n int")})
    alone = artifacts.story(spark, at("scan"))["story"].first()
    assert (alone["comparison_matches"], alone["drivers_matches"], alone["context_matches"], alone["driver_relation"], alone["warnings"]) == (None, None, None, None, [])
    found = artifacts.story(spark, at("scan"), drivers=at("drivers"), context=at("context"))
    told = found["story"].first()
    assert told["driver_relation"] == "historical-change-point" and told["drivers_matches"] is False
    assert told["warnings"] == [f"context is of {two}, scan of {one}"]
    for scan_folder, context in (("nameless", "context"), ("scan", "unknown")):
        assert artifacts.story(spark, at(scan_folder), context=at(context))["story"].first()["warnings"] == []
    # a section without rows keeps its columns and can be saved again
    assert found["drivers crossovers"].schema == crossed.schema
    artifacts.save(spark, at("story"), "story", one, {k.replace(" ", "_"): df for k, df in found.items()})
    assert "story" in artifacts.head(spark, at("story"), "story")["sections"]
