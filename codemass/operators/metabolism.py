"""Use of files over a window of frames: last use, last change, newer siblings and status.

``frames``: repository, frame (from 0), path, category, code_lines, active (boolean), print (content fingerprint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.scalars import family
from codemass.schema import MACHINERY, PRODUCT, among

SNAP, KEY = "snapshot_id", ["repository", "path"]
# Words of a path that tell that a document is kept for the record.
ARCHIVE_WORDS = ("handoff", "archive", "legacy", "history", "historical", "qualification", "release-notes")


def frame_metrics(frames: DataFrame) -> DataFrame:
    """(repository, frame, files, lines, product_lines, machinery_lines, active_files, active_lines)."""
    lines = lambda cond: F.sum(F.when(cond, F.col("code_lines")).otherwise(0)).cast("long")
    return frames.groupBy("repository", "frame").agg(
        F.count("*").alias("files"), F.sum("code_lines").cast("long").alias("lines"), lines(among("category", PRODUCT)).alias("product_lines"),
        lines(among("category", MACHINERY)).alias("machinery_lines"), F.sum(F.col("active").cast("long")).alias("active_files"),
        lines(F.col("active")).alias("active_lines"),
    )


def mass_delta(metrics: DataFrame) -> DataFrame:
    """(repository, start, current, delta) of lines between the first and the last frame."""
    return metrics.groupBy("repository").agg(F.min_by("lines", "frame").alias("start"),
        F.max_by("lines", "frame").alias("current")).withColumn("delta", F.col("current") - F.col("start"))


def changes(frames: DataFrame) -> DataFrame:
    """``frames`` with changed: the fingerprint differs from the frame before, or the file was not in it; never in frame 0."""
    by = W.partitionBy(*KEY).orderBy("frame")
    same = F.col("print").eqNullSafe(F.lag("print").over(by)) & (F.lag("frame").over(by) == F.col("frame") - 1)
    return frames.withColumn("changed", (F.col("frame") > 0) & ~F.coalesce(same, F.lit(False)))


def usage(frames: DataFrame) -> DataFrame:
    """(repository, path, observed_frames, first_seen, last_seen, last_use, last_change): frame numbers, null for never."""
    return changes(frames).groupBy(*KEY).agg(
        F.count("*").alias("observed_frames"), F.min("frame").alias("first_seen"), F.max("frame").alias("last_seen"),
        F.max(F.when(F.col("active"), F.col("frame"))).alias("last_use"), F.max(F.when(F.col("changed"), F.col("frame"))).alias("last_change"),
    )


def newer_siblings(paths: DataFrame) -> DataFrame:
    """(repository, path, newer): paths of the same version family with a greater number, in number order; none are left out."""
    name, number = family("path")
    members = paths.select("repository", "path", name.alias("family"), number.alias("number")).where("family is not null")
    by = W.partitionBy("repository", "family").orderBy("number").rangeBetween(1, W.unboundedFollowing)
    newer = F.collect_list(F.struct("number", "path")).over(by)
    rows = members.withColumn("_n", F.array_sort(newer)).where(F.size("_n") > 0)
    return rows.select("repository", "path", F.transform("_n", lambda n: n["path"]).alias("newer"))


def superseded(paths: DataFrame) -> DataFrame:
    """(repository, path): paths whose version family has a greater number; its greatest is enough to know."""
    name, number = family("path")
    members = paths.select("repository", "path", name.alias("family"), number.alias("number")).where("family is not null")
    last = members.groupBy("repository", "family").agg(F.max("number").alias("_last"))
    return members.join(last, ["repository", "family"]).where("number < _last").select("repository", "path").distinct()


def status_of(active: Column, newer: Column, archive: Column, last_use: Column, machinery: Column, observed: Column, total: Column) -> Column:
    """A file's status, the first that fits."""
    return (
        F.when(active, "active")
        .when(newer, "superseded-candidate")
        .when(archive, "archive-candidate")
        .when(last_use.isNotNull(), "dormant")
        .when(machinery & (observed >= F.least(F.lit(3), total)), "bounded-orphan-candidate")
        .otherwise("insufficient-evidence")
    )


def status(frames: DataFrame) -> DataFrame:
    """(repository, path, category, code_lines, status, observed_frames, last_use, last_change) of the last frame's files."""
    ends = frames.groupBy("repository").agg(F.max("frame").alias("_end"), F.countDistinct("frame").alias("_total"))
    now = frames.join(ends, "repository").where("frame = _end").select(*KEY, "category", "code_lines", "active", "_total")
    rows = now.join(usage(frames), KEY).join(superseded(now.select(*KEY)).withColumn("newer", F.lit(True)), KEY, "left")
    archive = (F.col("category") == "documentation") & F.lower("path").rlike("|".join(ARCHIVE_WORDS))
    value = status_of(F.col("active"), F.col("newer").isNotNull(), archive, F.col("last_use"), among("category", MACHINERY), F.col("observed_frames"),
        F.col("_total"))
    return rows.select(*KEY, "category", "code_lines", value.alias("status"), "observed_frames", "last_use", "last_change")


def status_counts(rows: DataFrame) -> DataFrame:
    """(repository, status, files, lines)."""
    return rows.groupBy("repository", "status").agg(F.count("*").alias("files"), F.sum("code_lines").cast("long").alias("lines"))


def structural_use(symbols: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(snapshot_id, path, kind, source, detail): exact relationships and resolved dependencies from other files."""
    place = symbols.select(SNAP, "id", "path")
    exact = edges.where("resolution = 'exact' and kind <> 'contains' and target_id is not null")
    ends = exact.join(place.select(SNAP, F.col("id").alias("target_id"), "path"),
        [SNAP, "target_id"]).join(place.select(SNAP, F.col("id").alias("source_id"), F.col("path").alias("source")), [SNAP, "source_id"])
    inbound = ends.where("path <> source").select(SNAP, "path", F.lit("exact_semantic_inbound").alias("kind"), "source",
        F.concat_ws(": ", "kind", "evidence").alias("detail"))
    named = dependencies.where("src <> dst").select(SNAP, F.col("dst").alias("path"), F.lit("local_dependency_inbound").alias("kind"),
        F.col("src").alias("source"), F.lit("").alias("detail"))
    return inbound.unionByName(named).distinct()


def capability_use(capabilities: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """(snapshot_id, path, kind, source, detail): files that declare or anchor a capability, and files that it reaches."""
    shown = capabilities.select(SNAP, "path", F.col("symbol_id").alias("anchor"), F.col("kind").alias("source"), F.col("name").alias("detail"))
    anchored = shown.drop("path").join(symbols.select(SNAP, F.col("id").alias("anchor"), "path"), [SNAP, "anchor"])
    through = shown.drop("path").join(reached.select(SNAP, "anchor", "path").distinct(), [SNAP, "anchor"])
    row = lambda kind: [SNAP, "path", F.lit(kind).alias("kind"), "source", "detail"]
    surface = shown.select(*row("capability_surface")).unionByName(anchored.select(*row("capability_surface")))
    return surface.unionByName(through.select(*row("capability_reachable"))).distinct()


def evidence(rows: DataFrame, *, keys: tuple[str, ...] = ("repository", "path")) -> DataFrame:
    """(keys, kinds, evidence): different evidence rows (kind, source, detail) in order; kinds without repetition."""
    each = rows.select(*keys, F.struct("kind", "source", "detail").alias("e")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("evidence")).withColumn("kinds",
        F.array_distinct(F.transform("evidence", lambda e: e["kind"])))
