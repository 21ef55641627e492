"""Intake of archives: damage fails closed, on the executors, and stops no other target."""

from __future__ import annotations

import io
import subprocess
import tarfile

import pytest

from codemass.plans import scan
from codemass.sources import records, trees


def packed(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body in files.items():
            m = tarfile.TarInfo(name)
            m.size = len(body)
            t.addfile(m, io.BytesIO(body))
    return out.getvalue()


def test_cut_archives_fail_closed():
    whole = packed({f"r/f{k}.py": bytes(range(256)) * 40 for k in range(30)})
    assert len(list(trees.members(io.BytesIO(whole), strict=True))) == 30
    assert len(list(trees.members(io.BytesIO(whole), strict=True, stream=True))) == 30
    for end in (0, 20, len(whole) // 2, len(whole) - 4):
        with pytest.raises(trees.TreeError, match="invalid-archive"):
            list(trees.members(io.BytesIO(whole[:end]), strict=True))
    with pytest.raises(trees.TreeError, match="invalid-archive"):
        list(trees.members(io.BytesIO(whole[: len(whole) // 2]), strict=True, stream=True))
    wrong = whole[:-8] + bytes(4) + whole[-4:]
    with pytest.raises(trees.TreeError, match="invalid-archive"):
        list(trees.members(io.BytesIO(wrong), strict=True))


def test_index_records_each_failure(spark, tmp_path):
    good = packed({"r/src/app.py": b"def run():\n    return 1\n", "r/tests/test_app.py": b"def test_run():\n    assert True\n"})
    (tmp_path / "good.tar.gz").write_bytes(good)
    (tmp_path / "cut.tar.gz").write_bytes(good[: len(good) // 2])
    (tmp_path / "unsafe.tar.gz").write_bytes(packed({"/etc/x.py": b"x"}))
    targets = spark.createDataFrame([("o/" + n, "a" * 40, str(tmp_path / f"{n}.tar.gz")) for n in ("good", "cut", "unsafe", "missing")],
        "repository string, sha string, path string")
    out = str(tmp_path / "corpus")
    made = {r["repository"]["name"]: r for r in scan.index(spark, targets, out, version="1", revision="r").collect()}
    assert {k: r["status"] for k, r in made.items()} == {"o/good": "ok", "o/cut": "failed", "o/unsafe": "failed", "o/missing": "failed"}
    assert [made["o/" + n]["reason"]["code"] for n in ("cut", "unsafe", "missing")] == ["invalid-archive", "unsafe-archive", "unreadable"]
    assert made["o/good"]["measurement"]["category_code_lines"]["core-product"] == 2
    assert records.corpus(spark, out).count() == 4
    # a second run scans what has failed again, but not what is known
    assert {r["repository"]["name"] for r in scan.index(spark, targets, out, version="1", revision="r").collect()} == {"o/cut", "o/unsafe", "o/missing"}


def test_partitions_follow_bytes(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"f{k}.py").write_bytes(b"x" * 1000)
    monkeypatch.setattr(trees, "BYTES_A_PARTITION", 2500)
    reader = trees._FolderReader(str(tmp_path), "t", 2000)
    parts = reader.partitions()
    assert [len(p.items) for p in parts] == [2, 2, 2] and sum(1 for p in parts for _ in reader.read(p)) == 6


def test_unknown_commit_is_an_error_of_git(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    with pytest.raises(trees.TreeError, match="git-error"):
        list(trees._GitReader(str(tmp_path), ["0" * 40]).read(trees._Part("0" * 40, ())))
