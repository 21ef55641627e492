"""Differences between two snapshots and events over a series of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.scalars import dominance


def category_deltas(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, category, before, after, delta) over all categories of either side; ``code_lines`` absent count 0."""
    on = [*keys, "category"]
    both = before.select(*on, F.col("code_lines").alias("before")).join(after.select(*on, F.col("code_lines").alias("after")), on, "full_outer")
    return both.fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def crossovers(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Folders that turned from mostly product to mostly machinery."""
    on = [*keys, "path"]
    side = lambda df, p: df.select(*on, F.col("product_lines").alias(f"{p}_product"), F.col("machinery_lines").alias(f"{p}_machinery"))
    both = side(before, "before").join(side(after, "after"), on)
    return both.where("before_product > before_machinery and after_machinery > after_product")


def inversion_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, change): inversions added and removed."""
    on = [*keys, "path"]
    a, b = before.where("is_inversion").select(*on), after.where("is_inversion").select(*on)
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


def deepest_chains(chains: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, signature, first, last): only the chains of greatest depth."""
    if keys:
        deep = chains.withColumn("_max", F.max("depth").over(W.partitionBy(*keys))).where("depth = _max")
    else:  # one row of the greatest depth, so that no task reads all chains
        deep = chains.crossJoin(F.broadcast(chains.agg(F.max("depth").alias("_max")))).where("depth = _max")
    return deep.select(*keys, F.array_join("symbol_ids", " -> ").alias("signature"), F.element_at("symbol_ids", 1).alias("first"),
        F.element_at("symbol_ids", -1).alias("last")).distinct()


def chain_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, change, before, after): chains added, removed, or changed between the same ends.

    Added and removed chains of the same ends are paired in signature order.
    """
    on = [*keys, "signature", "first", "last"]
    order = W.partitionBy(*keys, "first", "last").orderBy("signature")
    new = after.select(*on).join(before.select(*on), on, "left_anti").withColumn("k", F.row_number().over(order))
    old = before.select(*on).join(after.select(*on), on, "left_anti").withColumn("k", F.row_number().over(order))
    pair = [*keys, "first", "last", "k"]
    both = new.select(*pair, F.col("signature").alias("after")).join(old.select(*pair, F.col("signature").alias("before")), pair, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select(*keys, change.alias("change"), "before", "after")


def change_drivers(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = (), *, keep: int | None = 8) -> DataFrame:
    """Files by how many lines moved: all of a file that came, went or changed purpose, else the difference.

    Files without movement whose purpose stayed are left out.  ``keep``: the report's bound a key, None for all.
    """
    on = [*keys, "path"]
    side = lambda df, p: df.select(*on, F.col("category").alias(f"{p}_category"), F.col("code_lines").alias(f"{p}_code_lines"),
        F.lit(True).alias(f"_{p}"))
    both = side(before, "before").join(side(after, "after"), on, "full_outer")
    same = F.col("before_category").eqNullSafe(F.col("after_category"))
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(~same, "recategorized").otherwise("changed")
    both = both.withColumn("status", status).fillna(0, ["before_code_lines", "after_code_lines"])
    moved = F.when(same, F.abs(F.col("after_code_lines") - F.col("before_code_lines"))).otherwise(F.greatest("before_code_lines", "after_code_lines"))
    rows = both.withColumns({"movement": moved, "delta": F.col("after_code_lines") - F.col("before_code_lines")}).where(
        "movement > 0 or status <> 'changed'").drop("_before", "_after")
    if keep is None:
        return rows
    order = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return rows.withColumn("rank", F.row_number().over(order.orderBy(F.desc("movement"), "path"))).where(F.col("rank") <= keep)


def layout_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each file that appeared, disappeared, grew, shrank, or changed purpose or distance from value."""
    on = [*keys, "path"]
    side = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("weight", "category", "value_distance")],
        F.lit(True).alias(f"_{p}"))
    both = side(before, "before").join(side(after, "after"), on, "full_outer")
    there = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    delta = F.coalesce("after_weight", F.lit(0)) - F.coalesce("before_weight", F.lit(0))
    flags = {
        "appeared": F.col("_before").isNull(), "disappeared": F.col("_after").isNull(),
        "classification_changed": there & ~F.col("before_category").eqNullSafe(F.col("after_category")),
        "grew": there & (delta > 0), "shrunk": there & (delta < 0),
        "value_distance_changed": there & ~F.col("before_value_distance").eqNullSafe(F.col("after_value_distance")),
    }
    out = both.withColumns({**flags, "weight_delta": delta}).drop("_before", "_after").fillna(0, ["before_weight", "after_weight"])
    return out.where("appeared or disappeared or classification_changed or grew or shrunk or value_distance_changed")


FLAGS = ("appeared", "disappeared", "classification_changed", "grew", "shrunk", "value_distance_changed")


def layout_summary(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many files have each flag."""
    return changes.groupBy(*keys).agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS])


def paired(frames: DataFrame, key: str, order: str) -> DataFrame:
    """``frames`` with previous, the struct of the frame before it in its series; null for the first."""
    return frames.withColumn("previous", F.lag(F.struct(*frames.columns)).over(W.partitionBy(key).orderBy(order)))


def history_events(checkpoints: DataFrame, profiles: DataFrame, *, key: str = "repository", order: str = "frame") -> DataFrame:
    """(key, frame, type, path, before, after) between neighbouring frames, pinned to the later one.

    ``checkpoints``: key, frame, product_share, machinery_share, recursive_depth, frames numbered without gaps.
    ``profiles``: key, frame, path, product_lines, machinery_lines.
    """
    p = paired(checkpoints, key, order).where("previous is not null")
    left, right = dominance("previous.product_share", "previous.machinery_share"), dominance("product_share", "machinery_share")
    none = F.lit(None).cast("string")
    shift = p.where(left != right).select(key, order, F.lit("repository-dominance-shift").alias("type"), none.alias("path"), left.alias("before"),
        right.alias("after"))
    deep = p.where(F.col("recursive_depth") != F.col("previous.recursive_depth")).select(
        key, order, F.lit("recursive-depth-change").alias("type"), none.alias("path"),
        F.col("previous.recursive_depth").cast("string").alias("before"), F.col("recursive_depth").cast("string").alias("after")
    )
    moved = crossovers(profiles.withColumn(order, F.col(order) + 1), profiles, (key, order))
    lines = lambda s: F.concat_ws("/", F.col(f"{s}_product").cast("string"), F.col(f"{s}_machinery").cast("string"))
    crossed = moved.select(key, order, F.lit("directory-crossover").alias("type"), "path", lines("before").alias("before"), lines("after").alias("after"))
    return shift.union(deep).union(crossed)


def identity_flags(before: str = "before", after: str = "after") -> dict[str, Column]:
    """What changed between two measurements' identities: unknown sources and settings are no change, versions are."""
    x = lambda s, n: F.col(f"{s}.{n}")
    known = lambda n: F.coalesce(x(before, n) != x(after, n), F.lit(False))
    flags = {
        "analyzer_version_changed": ~x(before, "version").eqNullSafe(x(after, "version")), "analyzer_source_changed": known("source"),
        "canonical_setting_changed": known("canonical"), "target_sha_changed": known("sha"),
    }
    flags["like_for_like"] = ~(flags["analyzer_version_changed"] | flags["analyzer_source_changed"] | flags["canonical_setting_changed"])
    return flags


def explanations(deltas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rank, message) for each category that gained or lost lines, the largest first."""
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.desc(F.abs("delta")), "category")
    title = F.initcap(F.replace("category", F.lit("-"), F.lit(" ")))
    text = F.when(F.col("delta") > 0, F.concat(title, F.lit(" gained "), F.format_number("delta", 0), F.lit(" LOC."))).otherwise(
        F.concat(title, F.lit(" lost "), F.format_number(-F.col("delta"), 0), F.lit(" LOC.")))
    return deltas.where("delta <> 0").select(*keys, F.row_number().over(order).alias("rank"), text.alias("message"))


def structural_explanations(deltas: DataFrame, crossed: DataFrame, depth: DataFrame, chains: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, part, rank, message): what changed in words, in the order of parts and ranks.

    Parts: 0 categories, 1 folders that crossed over, 2 recursive depth (``depth``: keys, before, after), 3 and 4 the first chain
    that appeared and that went, 5 whether one kept its ends only.  Missing depths say nothing.
    """
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    at = lambda part: F.lit(part).alias("part")
    rows = explanations(deltas, keys).select(*keys, at(0), "rank", "message")
    over = crossed.select(*keys, at(1), F.row_number().over(by.orderBy("path")).alias("rank"),
        F.concat("path", F.lit(" crossed from product-dominant to machinery-dominant.")).alias("message"))
    how = F.when(F.col("after") > F.col("before"), "increased").otherwise("decreased")
    words = F.concat(F.lit("Max exact recursive depth "), how, F.lit(" from "), F.col("before").cast("string"), F.lit(" to "),
        F.col("after").cast("string"), F.lit("."))
    deep = depth.where("before <> after").select(*keys, at(2), F.lit(1).alias("rank"), words.alias("message"))

    def first(change: str, part: int, signature: str, before: str, after: str = "") -> DataFrame:
        found = chains.where(F.col("change") == change).groupBy(*keys).agg(F.min(signature).alias("_s")).where("_s is not null")
        return found.select(*keys, at(part), F.lit(1).alias("rank"), F.concat(F.lit(before), F.col("_s"), F.lit(after)).alias("message"))

    new = first("added", 3, "after", "A new deepest exact machinery chain appeared through ", ".")
    gone = first("removed", 4, "before", "A previously deepest exact machinery chain disappeared: ", ".")
    kept = chains.where("change = 'changed'").select(*keys, at(5), F.lit(1).alias("rank"),
        F.lit("A deepest exact chain kept the same endpoints but changed its internal structural path.").alias("message")).distinct()
    return rows.union(over).union(deep).union(new).union(gone).union(kept)


def story_coherence(scan: DataFrame, comparison: DataFrame) -> DataFrame:
    """One row: whether the comparison's later sha is the scan's, and the warning if not."""
    both = scan.select(F.col("sha").alias("scan_sha")).join(comparison.select("before_sha", "after_sha"), F.lit(True))
    match = F.coalesce(F.col("scan_sha") == F.col("after_sha"), F.lit(False))
    return both.withColumns({"matches": match, "warning": F.when(~match,
                F.concat(F.lit("comparison ends at "), F.coalesce("after_sha", F.lit("?")), F.lit(", scan is of "), F.coalesce("scan_sha", F.lit("?"))))})
