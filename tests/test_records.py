"""Corpora as JSON lines: where a broken line is, and what a batch may hold."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from codemass.sources import records


def test_broken_lines_have_their_numbers_in_any_split(spark, tmp_path):
    home = tmp_path / "corpus"
    home.mkdir()
    good = [json.dumps({"status": "ok", "identity": f"i{k}" * (1 + k % 7)}) for k in range(4000)]
    good[10] = good[11] = good[3000] = "   "
    (home / "a.jsonl").write_text("\n".join(good) + "\n")
    late = list(good)
    late[3777], late[3778], late[20] = "{broken", "[1]", "7"
    (home / "b.jsonl").write_bytes("\r\n".join(late).encode())
    with gzip.open(home / "c.jsonl.gz", "wt") as f:
        f.write("\n\n" + good[0] + "\nno\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("3000", "50000", "128m"):
            spark.conf.set(key, size)
            rows = [(r["file"].rsplit("/", 1)[1], r["line"], r["lines"], r["text"]) for r in records.broken_lines(spark, str(home)).orderBy("file", "line").collect()]
            assert rows[0][:2] == ("b.jsonl", 21) and rows[-1] == ("c.jsonl.gz", 4, 1, "no") and sum(r[2] for r in rows) == 4, size
            if size == "3000":
                assert spark.read.text(str(home)).rdd.getNumPartitions() > 20 and ("b.jsonl", 3778) in {r[:2] for r in rows}
            with pytest.raises(ValueError, match=r"b\.jsonl, line 21: 7"):
                records.corpus(spark, str(home))
    finally:
        spark.conf.set(key, before)
    assert records.corpus(spark, str(home / "a.jsonl")).count() == 3997
    (home / "empty.jsonl").write_text("")
    assert records.broken_lines(spark, str(home / "empty.jsonl")).isEmpty() and records.corpus(spark, str(home / "empty.jsonl")).isEmpty()


def test_a_batch_is_added_whole_with_keys_in_order(spark, tmp_path):
    kind = "status string, z struct<b:double,a:map<string,double>,c:array<struct<y:int,x:double>>>, identity string"
    one = ("ok", (1.5, {"k2": 2.0, "k1": 1.0}, [(3, 0.5)]), "i1")
    out = str(tmp_path / "corpus")
    records.append(spark.createDataFrame([one, ("skipped", None, "i2"), ("failed", None, "i3")], kind), out)
    lines = sorted(r["value"] for r in spark.read.text(out).collect())
    assert lines == ['{"identity":"i1","status":"ok","z":{"a":{"k1":1.0,"k2":2.0},"b":1.5,"c":[{"x":0.5,"y":3}]}}', '{"identity":"i3","status":"failed"}']
    assert all(line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":")) for line in lines)
    for odd in (("ok", (float("nan"), None, None), "n"), ("ok", (1.0, {"k": float("-inf")}, None), "n"), ("ok", (1.0, None, [(1, float("inf"))]), "n")):
        with pytest.raises(Exception, match="not a finite number"):
            records.append(spark.createDataFrame([one, odd] + [one] * 20, kind).repartition(4), out)
    assert spark.read.text(out).where(F.trim("value") != "").count() == 2
