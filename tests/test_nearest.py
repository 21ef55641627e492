"""Nearest repositories by pivots and boxes against meeting every record."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codemass.operators import corpus, nearest

SCHEMA = """repository string, sha string, scanned_at string, seq int, model string, canonical boolean, identity string, code_shares array<double>, code_total long,
 symbol_shares array<double>, symbol_total long, recursive_depth int, semantic_index double, far_share double, exact_coverage double"""


def near(draw, shares):
    moved = [max(0.0, x + draw.uniform(0, 0.01)) for x in shares]
    return [x / sum(moved) for x in moved]


def rows(draw, n, clusters, scans=1):
    centres = []
    for _ in range(clusters):
        c = [draw.random() ** 4 for _ in range(24)]
        centres.append(([x / sum(c[:12]) for x in c[:12]], [x / sum(c[12:]) for x in c[12:]], draw.randrange(12), draw.uniform(0, 90), draw.random(), draw.random()))
    out = []
    for k in range(n):
        code, symbols, depth, index, far, exact = draw.choice(centres)
        code, symbols = near(draw, code), near(draw, symbols)
        for s in range(scans):
            out.append((f"o/R{k}", f"s{s}", f"{2000 + s}", s, "m1", True, f"o/r{k}:s{s}", code, 100, symbols, 50, depth, index + draw.random(), far, exact))
    return out


def odd(draw):
    """Missing dimensions, settings, models, shares and ties."""
    out = [list(r) for r in rows(draw, 150, 6)]
    for r in out:
        if draw.random() < 0.2:
            r[8], r[7] = 0, [0.0] * 12
        if draw.random() < 0.3:
            r[10], r[9] = 0, [0.0] * 12
        if draw.random() < 0.4:
            r[14] = None
        r[4] = draw.choice(["m1", "m1", "m2", None])
        r[5] = draw.choice([True, True, False, None])
        if draw.random() < 0.1:
            r[7] = r[8] = None
        if draw.random() < 0.3:
            r[0], r[6] = "o/same", f"o/same:{len(out)}{draw.random()}"
    return out + [list(r) for r in draw.sample(out, 20)]


def told(frame):
    return sorted((r["query"], r["rank"], r["repository"], r["sha"], r["distance"]) for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"cross_model": True}, {"same_repository": True}])
def test_equals_meeting_every_record(spark, options):
    records = spark.createDataFrame([tuple(r) for r in odd(random.Random(5))], SCHEMA)
    queries = records.where("code_shares is not null")
    assert told(nearest.nearest(queries, records, keep=4, **options)) == told(corpus.neighbours(queries, records, keep=4, **options))


def test_few_records_and_none(spark):
    records = spark.createDataFrame(rows(random.Random(1), 3, 1), SCHEMA)
    assert told(nearest.nearest(records, records)) == told(corpus.neighbours(records, records)) != []
    assert told(nearest.nearest(records, records.limit(0))) == told(nearest.nearest(records.limit(0), records)) == []


def test_clustered_corpus_meets_under_a_tenth(spark):
    """Every record is a query; one repository has a third of all records."""
    draw = random.Random(8)
    found = rows(draw, 2000, 60)
    centre = found[0]
    found += [("o/Hot", f"s{k}", "2001", k, "m1", True, f"o/hot:{k}", near(draw, centre[7]), 100, near(draw, centre[9]), 50, *centre[11:]) for k in range(1000)]
    records = spark.createDataFrame(found, SCHEMA).repartition(4).cache()
    met = nearest.candidates(records, records, keep=5)
    assert met.count() * 10 < len(found) ** 2
    some = records.where(F.crc32("identity") % 50 == 0)
    asked = {r[0] for r in some.select("identity").collect()}
    got = [r for r in told(nearest.nearest(records, records, keep=5)) if r[0] in asked]
    assert got == told(corpus.neighbours(some, records, keep=5))
