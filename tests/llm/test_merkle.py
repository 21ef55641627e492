"""Manifests against a plain Merkle tree."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codemass.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    doc_id, source, lang, n, _ = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and each node's (left, right) of every level."""
    paths: list[list] = [[] for _ in nodes]
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        for n, at in enumerate(own):
            run = nodes[at - at % fanout : at - at % fanout + fanout]
            paths[n].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        own = [at // fanout for at in own]
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows: list[tuple], fanout: int) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r, r[4])))
    made = {}
    for lang, members in groups.items():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        made[lang] = (members, *tree([m[1] for m in members], fanout))
    order = sorted(made, key=lambda x: (x is not None, (x or "").encode()))
    root, high = tree([made[x][1] for x in order], fanout)
    out = Counter()
    for n, lang in enumerate(order):
        members, subroot, paths = made[lang]
        for (r, digest), path in zip(members, paths, strict=True):
            path = path + high[n]
            now = leaf(r, r[4].translate({c: c + 32 for c in range(65, 91)}) if r[4] is not None and r[0] and r[0] % 3 == 0 else r[4])
            for left, right in path:
                now = h(left + now + right)
            out[(r[0], digest, subroot, root, h("".join(a + b for a, b in path)), now, now == root)] += 1
    return out


def built(docs, fanout: int) -> Counter:
    digest = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = F.when((F.col("doc_id") != 0) & (F.col("doc_id") % 3 == 0), digest(lower)).otherwise(digest(F.col("text")))
    found = merkle.proofs(docs.withColumns({"leaf": digest(F.col("text")), "_now": now}), fanout=fanout)
    found = found.withColumn("_root", merkle.fold(F.col("_now"), F.col("path")))
    columns = ["doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "_root", F.col("_root") == F.col("root")]
    return Counter(map(tuple, found.select(*columns).collect()))


def rows(langs: dict) -> list[tuple]:
    return [(i * 7 % 1009, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, f"Text {i} É Ab" if i % 6 else None)
        for lang, n in langs.items() for i in range(n)]


@pytest.mark.parametrize("fanout", [2, 8])
def test_proofs_equal_a_plain_tree(spark, fanout):
    data = rows({None: 3, "": 1, "en": 130, "de": 8, "fr": 9, "é": 65, "z": 1, "日": 2})
    # repeated ids, equal rows, no id, values that hold the marks of a leaf, all null
    data += [data[20], data[20], (data[30][0], "other", "en", 1, "OTHER"), (None, "a", "en", 1, "X"), (None, "b", "en", 1, "Y"), (5, "1:x", "-", 3, ""),
        (6, "-", "-", 3, "-"), (None, None, None, None, None)]
    for parts in (1, 5):
        docs = spark.createDataFrame(data, SCHEMA).repartition(parts).withColumns({"root": F.lit("clash"), "path": F.lit(1), "_pos": F.lit(2), "_h0": F.lit(3)})
        assert built(docs, fanout) == brute(data, fanout)


@pytest.mark.parametrize("langs", [{"en": 1}, {"en": 2}, {"en": 64}, {"en": 65}, {f"l{i}": 1 for i in range(20)}])
def test_small_trees(spark, langs):
    data = rows(langs)
    assert built(spark.createDataFrame(data, SCHEMA), 8) == brute(data, 8)


def test_an_empty_table_has_no_tree(spark):
    assert built(spark.createDataFrame([], SCHEMA), 8) == Counter()
