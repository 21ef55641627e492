"""Treemaps: every snapshot's files in one rectangle, sliced a folder level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed

SNAP = "snapshot_id"


def tree(components: DataFrame) -> DataFrame:
    """(snapshot_id, path, parent, kind, weight, depth): folders and files of positive weight, weights summed upwards."""
    files = components.where("code_lines > 0").select(SNAP, "path", F.col("code_lines").cast("long").alias("weight"))
    parts = F.split("path", "/")
    n = F.size(parts)
    each = files.select(SNAP, "weight", "path", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    cut = each.withColumn("node", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    nodes = cut.groupBy(SNAP, F.col("node").alias("path"), "depth").agg(F.sum("weight").alias("weight"), F.max(F.col("node") == F.col("path")).alias("_file"))
    above = F.when(F.col("depth") == 1, F.lit("")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return nodes.select(SNAP, "path", above.alias("parent"), F.when(F.col("_file"), "file").otherwise("directory").alias("kind"), "weight", "depth")


def treemap(components: DataFrame, *, width: float = 1000.0, height: float = 620.0) -> DataFrame:
    """(snapshot_id, kind, path, x, y, width, height, weight, depth, category, value_distance), rounded to six decimals.

    A rectangle is split along its longer side among its children, the heaviest first; the last takes what is left.
    Each child is padded inwards.  One pass a folder level, over all snapshots at once.
    """
    nodes = checkpointed(tree(components))
    by = W.partitionBy(SNAP, "parent").orderBy(F.desc("weight"), "path")
    whole = W.partitionBy(SNAP, "parent")
    ranked = nodes.withColumns({"_before": F.coalesce(F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("weight").over(whole), "_last": F.row_number().over(by) == F.count("*").over(whole)})
    ranked = checkpointed(ranked)
    deepest = ranked.agg(F.max("depth")).first()[0] or 0
    box = nodes.select(SNAP).distinct().select(SNAP, F.lit("").alias("parent"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"),
        F.lit(float(width)).alias("pw"), F.lit(float(height)).alias("ph"))
    done = None
    for depth in range(1, deepest + 1):
        level = ranked.where(F.col("depth") == depth).join(box, [SNAP, "parent"])
        flat = F.col("pw") >= F.col("ph")
        side = F.when(flat, F.col("pw")).otherwise(F.col("ph"))
        at = side * (F.col("_before") / F.col("_total"))
        size = F.greatest(F.lit(0.0), F.when(F.col("_last"), side - at).otherwise(side * (F.col("weight") / F.col("_total"))))
        raw = level.withColumns({
            "cx": F.when(flat, F.col("px") + at).otherwise(F.col("px")), "cy": F.when(flat, F.col("py")).otherwise(F.col("py") + at),
            "cw": F.when(flat, size).otherwise(F.col("pw")), "ch": F.when(flat, F.col("ph")).otherwise(size),
        })
        pad = F.when(F.col("kind") == "directory", F.least(F.lit(2.5), F.col("cw") * 0.02, F.col("ch") * 0.02)).otherwise(0.8)
        rows = raw.select(
            SNAP, "kind", "path", (F.col("cx") + pad).alias("x"), (F.col("cy") + pad).alias("y"), F.greatest(F.lit(0.0), F.col("cw") - 2 * pad).alias("width"),
            F.greatest(F.lit(0.0), F.col("ch") - 2 * pad).alias("height"), "weight", "depth",
        )
        rows = checkpointed(rows)
        box = rows.where("kind = 'directory'").select(SNAP, F.col("path").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"),
            F.col("width").alias("pw"), F.col("height").alias("ph"))
        done = rows if done is None else done.union(rows)
    if done is None:
        done = ranked.select(SNAP, "kind", "path", *[F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")], "weight", "depth")
    role = components.select(SNAP, "path", "category", "value_distance")
    return done.withColumns({c: F.round(c, 6) for c in ("x", "y", "width", "height")}).join(role, [SNAP, "path"], "left")
