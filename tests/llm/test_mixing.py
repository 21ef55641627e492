"""Mixes against plain targets, and the schedule's promises."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codemass.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    held = defaultdict(list)
    for k, s, t in rows:
        held[s].append((hashlib.sha256(f"13:{'-' if k is None else k}".encode()).hexdigest(), size(t), k))
    targets = plain_targets({s: sum(r[1] for r in v) for s, v in held.items()})
    out = []
    for s, docs in held.items():
        whole, at, words = sum(d[1] for d in docs), 0, int(targets[s] + 0.5)
        for _, n, k in sorted(docs, key=lambda d: (d[0], d[1])):
            took = sum(max(0, min(a + n, words) - a) for a in (at, at + whole))
            out.append((k, n, whole, round(targets[s], 6), took))
            at += n
    return sorted(out, key=str)


def corpus(rnd: random.Random) -> list[tuple]:
    rows = [(i, rnd.choice(["a"] * 6 + ["b", "c", "é", "z", "Z", None]), " ".join("w" * rnd.choice([1, 1, 5, 40]) for _ in range(rnd.choice([0, 1, 3, 30, 200]))))
        for i in range(400)]
    rows += [(1000, "tiny", "one"), (1001, "none", None), (1002, "none", ""), (1003, "none", " \n\t"), (1004, "a", "x y\x85z " * 9), (7, "a", "again and again"),
        (7, "b", "other text"), (None, "c", "no id"), (None, "c", "no id"), (1005, "long", "word " * 9000), (8, rows[8][1], rows[8][2])]
    return rows


@pytest.mark.parametrize("block", [3, 64, 1024])
def test_taken_words_equal_plain_targets(spark, block):
    rows = corpus(random.Random(2))
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"size": F.lit("clash"), "_row": F.lit(1), "slot": F.lit(2)})
        got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.taken(docs, block=block).collect()), key=str)
        assert got == brute(rows)
    by_source = defaultdict(int)
    for k, s, _ in rows:
        by_source[s] += 1
    assert all(r[4] <= 2 * r[1] for r in got)


def test_the_mix_is_whole_even_and_repeatable(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([r for r in rows if r[0] not in (7, 8, None)], SCHEMA)
    first = [tuple(r) for r in mixing.mix(docs, block=16).collect()]
    assert sorted(first, key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3), block=16).collect()), key=str)
    texts = {k: size(t) for k, _, t in rows if k not in (7, 8, None)}
    covered = Counter()
    for slot, _, k, copy, start, length in first:
        assert length > 0 and start >= 0 and start + length <= texts[k]
        covered.update((k, copy, w) for w in range(start, start + length))
    assert set(covered.values()) == {1}
    # every stretch of the mix holds each source close to its share, and a source's slots are equal to a word
    per = defaultdict(Counter)
    for slot, s, *_, length in first:
        per[s][slot] += length
    last = max(x[0] for x in first)
    for s, slots in per.items():
        whole = sum(slots.values())
        assert max(slots.values()) - min(slots.values()) <= 1
        for upto in (last // 4, last // 2):
            assert abs(sum(n for x, n in slots.items() if x < upto) - whole * upto / last) <= 6 * 16


def test_hot_and_empty_sources(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)
    assert sorted(map(tuple, mixing.taken(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = [(i, "only", "x y z") for i in range(50)]
    assert sorted(map(tuple, mixing.taken(spark.createDataFrame(one, SCHEMA), block=8).collect()), key=str) == brute(one)
    many = [(i, f"s{i}", "w " * (1 + i % 9)) for i in range(300)]
    assert sorted(((*r[:3], round(r[3], 6), r[4]) for r in mixing.taken(spark.createDataFrame(many, SCHEMA), block=8).collect()), key=str) == brute(many)
