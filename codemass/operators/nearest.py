"""Nearest repositories of many records at once, without meeting every record.

Where neither side lacks a dimension, the structural distance is a sum of weighted absolute differences, so a record is a point whose
distances are plain sums over coordinates.  Records lie in blocks: rings around pivots, of one setting and one pattern of missing
dimensions.  The gaps between the boxes of two blocks bound all distances between them from below, and a query's keep-th nearest
representative bounds what it looks for from above; only records of blocks within that bound are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.scalars import ordered_sum
from codemass.operators.corpus import SHARDS, WEIGHTS, structural_distance
from codemass.schema import CATEGORIES

#: Pivots, the only rows that reach the driver; rows of a block; nearest blocks of representatives that are looked at first.
PIVOTS, BLOCK, FIRST = 64, 128, 4
#: What rounding may move between a bound and a distance.
SLACK = 1e-9
ROW = ("repository", "sha", "identity", "model", "canonical", "code_shares", "code_total", "symbol_shares", "symbol_total", "recursive_depth",
    "semantic_index", "far_share", "exact_coverage")


def _coordinates() -> list[tuple[str, Column]]:
    """(dimension, coordinate): differences of coordinates add up to the weighted distance; null where the dimension is missing."""
    out = []
    for name, side in (("code_composition", "code"), ("symbol_composition", "symbol")):
        there = F.col(f"{side}_total") > 0
        out += [(name, F.when(there, F.col(f"{side}_shares")[k] * (WEIGHTS[name] / 2))) for k in range(len(CATEGORIES))]
    depth = F.col("recursive_depth")
    scalars = {"recursive_depth": depth / (depth + 3.0), "semantic_index": F.col("semantic_index") / 100.0, "far_from_value": F.col("far_share"),
        "exact_coverage": F.col("exact_coverage")}
    return out + [(name, value * WEIGHTS[name]) for name, value in scalars.items()]


def _points(rows: DataFrame, cross_model: bool) -> DataFrame:
    """``rows`` with _set (the setting that records are compared within), _at (coordinates) and _has (weights of dimensions, 0 if missing)."""
    at = _coordinates()
    first = {name: column for name, column in reversed(at)}
    setting = F.lit("") if cross_model else F.concat_ws(":", F.coalesce(F.col("canonical").cast("string"), F.lit("-")), "model")
    has = F.array(*[F.when(first[name].isNotNull(), F.lit(weight)).otherwise(0.0) for name, weight in WEIGHTS.items()])
    # a null model equals no other
    found = rows if cross_model else rows.where("model is not null")
    return found.withColumns({"_set": setting, "_at": F.array(*[c for _, c in at]), "_has": has})


def _pivots(points: DataFrame) -> list[list[float]]:
    """Coordinates of the PIVOTS records of least hash, missing ones as 0."""
    full = F.transform("_at", lambda x: F.coalesce(x, F.lit(0.0)))
    return [r["p"] for r in points.select(full.alias("p"), F.xxhash64("identity", "repository").alias("h")).distinct().orderBy("h", "p").limit(PIVOTS).collect()]


def _blocks(points: DataFrame, pivots: list[list[float]], size: int) -> DataFrame:
    """``points`` with _row and _block: at most ``size`` neighbouring rows of a ring around one pivot; written, so that both stay."""
    away = F.transform(F.lit(pivots) if pivots else F.array(F.array(F.lit(0.0))),
        lambda p: F.aggregate(F.zip_with(p, "_at", lambda x, y: F.coalesce(F.abs(x - y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
    cells = points.withColumn("_away", away).withColumn("_ring", F.array_min("_away")).withColumn("_cell", F.array_position("_away", F.col("_ring")))
    order = ["_set", "_has", "_cell", "_ring", F.xxhash64("identity", "repository", "sha")]
    placed = cells.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    block = F.xxhash64(F.floor(F.col("_row") / size), "_set", "_has", "_cell")
    return checkpointed(placed.withColumn("_block", block).drop("_away", "_ring", "_cell"))


def _boxes(blocks: DataFrame, *more: Column) -> DataFrame:
    """(_set, _block, _has, _low, _high): the box of each block."""
    n = len(_coordinates())
    ends = [F.array(*[of(F.col("_at")[k]) for k in range(n)]).alias(name) for of, name in ((F.min, "_low"), (F.max, "_high"))]
    return blocks.groupBy("_set", "_block", "_has").agg(*ends, *more)


def _bound(low: Column, high: Column, has: Column, other: str) -> Column:
    """The least distance that any point within a box may have from any within the box of alias ``other``."""
    c = lambda name: F.col(f"{other}.{name}")
    gaps = F.zip_with(F.zip_with(low, c("_high"), lambda a, b: a - b), F.zip_with(c("_low"), high, lambda a, b: a - b),
        lambda a, b: F.coalesce(F.greatest(a, b, F.lit(0.0)), F.lit(0.0)))
    both = ordered_sum([F.least(has[k], c("_has")[k]) for k in range(len(WEIGHTS))])
    return F.coalesce(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.nullif(both, F.lit(0.0)), F.lit(0.0))


def _box_pairs(asking: DataFrame, boxes: DataFrame) -> DataFrame:
    """(_q, _block, _bound, and _reach if ``asking`` has it): boxes of one setting, joined in SHARDS, not row by row."""
    dealt = asking.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))).alias("q")
    spread = boxes.withColumn("_s", F.pmod("_block", F.lit(SHARDS)).cast("int")).alias("c")
    met = spread.join(dealt, (F.col("c._s") == F.col("q._s")) & (F.col("c._set") == F.col("q._set")))
    reach = [F.col("q._reach")] if "_reach" in asking.columns else []
    return met.select(F.col("q._block").alias("_q"), F.col("c._block").alias("_block"), *reach,
        _bound(F.col("q._low"), F.col("q._high"), F.col("q._has"), "c").alias("_bound"))


def _may(same_repository: bool) -> Column:
    """Whether record c may be a neighbour of query q."""
    other = ~F.coalesce(F.col("c.identity") == F.col("q.identity"), F.lit(False))
    return other if same_repository else other & ~F.coalesce(F.lower("c.repository") == F.lower("q.repository"), F.lit(False))


def candidates(queries: DataFrame, corpus: DataFrame, *, keep: int = 10, same_repository: bool = False, cross_model: bool = False) -> DataFrame:
    """Pairs of a query (alias q) and a record (alias c) with ``d``, their distance: all that can be among a query's ``keep`` nearest
    repositories, and few others.

    Nothing is left out for its number: where too few repositories are near, a query's bound is open and it meets all records of its
    setting.  Records without code shares or, unless ``cross_model``, without a model are no candidates.
    """
    records = _points(corpus.where("code_shares is not null"), cross_model)
    pivots = _pivots(records)
    asked = _blocks(_points(queries.select(*ROW), cross_model), pivots, BLOCK)
    held = _blocks(records.select(*ROW, "_set", "_at", "_has"), pivots, BLOCK)
    # one record stands for each repository, so that a block of them has as many repositories as rows
    one = held.groupBy("_set", F.lower("repository").alias("_r")).agg(F.max_by(F.struct(*ROW, "_at", "_has"), "_row").alias("c"))
    near = _blocks(one.select("_set", "c.*"), pivots, max(BLOCK // 4, 2 * keep))
    pairs = _box_pairs(_boxes(asked), _boxes(near))
    first = pairs.withColumn("_k", F.row_number().over(W.partitionBy("_q").orderBy("_bound", "_block"))).where(F.col("_k") <= FIRST).select("_q", "_block")
    looked = asked.alias("q").join(first.alias("p"), F.col("p._q") == F.col("q._block")).join(near.alias("c"), F.col("c._block") == F.col("p._block"))
    ranks = F.sort_array(F.collect_list("d.distance"))
    found = looked.where(_may(same_repository)).withColumn("d", structural_distance()).groupBy(F.col("q._row").alias("_row")).agg(ranks.alias("_d"))
    reach = F.coalesce(F.get("_d", F.lit(keep - 1)), F.lit(float("inf")))
    bounded = checkpointed(asked.join(found.select("_row", reach.alias("_reach")), "_row", "left").fillna(float("inf"), ["_reach"]))
    asking = _boxes(bounded, F.max("_reach").alias("_reach"))
    boxes = checkpointed(_boxes(held))
    within = _box_pairs(asking, boxes).where(F.col("_bound") <= F.col("_reach") + SLACK).select("_q", "_block")
    each = bounded.alias("q").join(within.alias("p"), F.col("p._q") == F.col("q._block")).join(boxes.alias("b"), F.col("b._block") == F.col("p._block"))
    own = _bound(F.col("q._at"), F.col("q._at"), F.col("q._has"), "b") <= F.col("q._reach") + SLACK
    rows = each.where(own).select(F.struct("q.*").alias("q"), F.col("p._block").alias("_of"))
    met = rows.join(held.alias("c"), F.col("c._block") == F.col("_of"))
    return met.where(_may(same_repository)).withColumn("d", structural_distance())


def nearest(queries: DataFrame, corpus: DataFrame, *, keep: int = 10, **options) -> DataFrame:
    """(query, repository, sha, distance, rank): as ``corpus.neighbours``, for many queries; a top-k report."""
    found = candidates(queries, corpus, keep=keep, **options)
    rows = found.select(F.col("q.identity").alias("query"), F.col("c.repository").alias("repository"), F.col("c.sha").alias("sha"),
        F.col("d.distance").alias("distance"))
    best = rows.groupBy("query", F.lower("repository").alias("_r")).agg(F.min(F.struct("distance", "repository", "sha")).alias("b"))
    order = W.partitionBy("query").orderBy("distance", "repository", "sha")
    return best.select("query", "b.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
