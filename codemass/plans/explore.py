"""Bounded row selections that reports and records are made of; each is a top-k with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.schema import MACHINERY, among

SNAP = "snapshot_id"


def top(rows: DataFrame, by: list[str], order: list[Column | str], keep: int) -> DataFrame:
    """``rows`` with rank, the first ``keep`` of each group; Spark cuts groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= keep)


def file_explorer(components: DataFrame, *, keep: int = 160) -> DataFrame:
    """Files worth a look: machinery first, then the farthest from value, then the longest."""
    far = F.coalesce("value_distance", F.lit(0))
    return top(components.withColumn("_m", among("category", MACHINERY)), [SNAP], [F.desc("_m"), F.desc(far), F.desc("code_lines"), "path"], keep).drop("_m")


def symbol_explorer(symbols: DataFrame, *, keep: int = 180) -> DataFrame:
    """Symbols worth a look: machinery first, then the farthest from value, then the surest of their role (where it is given)."""
    rows = symbols.where("kind <> 'file'").withColumn("_m", among("category", MACHINERY))
    sure = [F.desc("role_confidence")] if "role_confidence" in symbols.columns else []
    order = [F.desc("_m"), F.desc(F.coalesce("value_distance", F.lit(0))), *sure, "path", "start_line", "qualified_name", "id"]
    return top(rows, [SNAP], order, keep).drop("_m")


def chain_explorer(chains: DataFrame, symbols: DataFrame, *, keep: int = 8) -> DataFrame:
    """(snapshot_id, rank, step, id, name, path, line, relationship): the deepest recursive chains, a row for each symbol on them.

    ``relationship`` is the kind of the edge to the symbol before; the first step has none.  A symbol that is not known keeps its id.
    """
    best = top(chains, [SNAP], [F.desc("depth"), "symbol_ids"], keep)
    steps = best.select(SNAP, "rank", F.posexplode("symbol_ids").alias("step", "id"), "relationships")
    own = symbols.select(SNAP, "id", F.col("qualified_name").alias("name"), "path", F.col("start_line").alias("line"))
    return steps.join(own, [SNAP, "id"], "left").select(SNAP, "rank", "step", "id", F.coalesce("name", "id").alias("name"), "path", "line",
        F.when(F.col("step") > 0, F.get("relationships", F.col("step") - 1)).alias("relationship"))


def edge_explorer(reached: DataFrame, edges: DataFrame, *, keep: int = 80) -> DataFrame:
    """(snapshot_id, anchor, rank, source_id, target_id, kind, evidence, more): the first exact relationships among what each anchor
    reaches; ``more`` is how many there are beyond these.

    ``reached``: snapshot_id, anchor, id.  Anchors without relationships have no row.
    """
    exact = edges.where("resolution = 'exact' and target_id is not null").select(SNAP, F.col("source_id").alias("id"), "target_id", "kind", "evidence")
    rows = reached.select(SNAP, "anchor", "id").distinct().join(exact, [SNAP, "id"]).withColumnRenamed("id", "source_id")
    counts = rows.groupBy(SNAP, "anchor").agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("more"))
    return top(rows, [SNAP, "anchor"], ["source_id", "target_id", "kind", "evidence"], keep).join(counts, [SNAP, "anchor"]).select(SNAP,
        "anchor", "rank", "source_id", "target_id", "kind", "evidence", "more")


def chain_flags(components: DataFrame, chains: DataFrame, symbols: DataFrame) -> DataFrame:
    """(snapshot_id, path, on_deepest_chain): whether a symbol on one of the snapshot's deepest recursive chains lies in the file."""
    deepest = chains.groupBy(SNAP).agg(F.max("depth").alias("depth")).where("depth > 0")
    on = chains.join(deepest, [SNAP, "depth"]).select(SNAP, F.explode("symbol_ids").alias("id")).distinct()
    paths = symbols.select(SNAP, "id", "path").join(on, [SNAP, "id"]).select(SNAP, "path").distinct().withColumn("on_deepest_chain", F.lit(True))
    return components.select(SNAP, "path").join(paths, [SNAP, "path"], "left").fillna(False, ["on_deepest_chain"])


def folder_flags(components: DataFrame, profiles: DataFrame) -> DataFrame:
    """(snapshot_id, folder, code_lines, files, is_inversion): what lies below each folder, at any depth, and whether it is inverted."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = components.where(F.size(parts) > 1).select(SNAP, "code_lines", F.explode(above).alias("folder"))
    inverted = profiles.where("is_inversion").select(SNAP, F.col("path").alias("folder"), "is_inversion")
    sums = below.groupBy(SNAP, "folder").agg(F.sum("code_lines").alias("code_lines"), F.count("*").alias("files"))
    return sums.join(inverted, [SNAP, "folder"], "left").fillna(False, ["is_inversion"])


def semantic_chains(chains: DataFrame, *, keep: int = 50, by: str = "symbol_ids") -> DataFrame:
    """The recursive chains that a record keeps: the deepest of each snapshot, then by their symbols (or the codes of these)."""
    return top(chains, [SNAP], [F.desc("depth"), by], keep)


def diagnostic_explorer(diagnostics: DataFrame, *, keep: int = 50) -> DataFrame:
    """Diagnostics, the most severe first."""
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return top(diagnostics, [SNAP], [severity, "path", "message"], keep)


def folder_files(components: DataFrame, *, keep: int = 40) -> DataFrame:
    """(snapshot_id, folder, rank, path, code_lines): the longest files below each folder, at any depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = components.where(F.size(parts) > 1).select(SNAP, "path", "code_lines", F.explode(above).alias("folder"))
    return top(rows, [SNAP, "folder"], [F.desc("code_lines"), "path"], keep)


def file_symbols(symbols: DataFrame, *, keep: int = 30) -> DataFrame:
    """(snapshot_id, path, rank, id): the first symbols of each file."""
    return top(symbols.where("kind <> 'file'"), [SNAP, "path"], ["start_line", "qualified_name", "id"], keep).select(SNAP, "path", "rank", "id",
        "kind", "category")


def representative_chains(chains: DataFrame, *, keep: int = 5) -> DataFrame:
    """The deepest chains of each snapshot, then by their symbols."""
    return top(chains, [SNAP], [F.desc("depth"), "symbol_ids"], keep)


def representative_inversions(profiles: DataFrame, *, keep: int = 5) -> DataFrame:
    """The sharpest inversions of each snapshot."""
    return top(profiles.where("is_inversion"), [SNAP], [F.desc("scaffolding_ratio"), F.desc("code_lines"), "path"], keep)


def layout_order(changes: DataFrame, by: list[str], *, keep: int = 30) -> DataFrame:
    """Layout changes: files that came or went first, then by lines moved, then purpose changes."""
    moved = F.when(F.col("appeared") | F.col("disappeared"), 0).otherwise(1)
    return top(changes, by, [moved, F.desc(F.abs("weight_delta")), F.desc("classification_changed"), "path"], keep)


def metabolism_order(rows: DataFrame, *, keep: int = 160) -> DataFrame:
    """Files by how removable they look, the longest first."""
    from codemass.schema import METABOLISM_STATUS

    rank = F.array_position(F.array(*map(F.lit, METABOLISM_STATUS)), F.col("status"))
    return top(rows, ["repository"], [rank, F.desc("code_lines"), "path"], keep)


def with_baseline(deltas: DataFrame, frames: DataFrame, values: list[str]) -> DataFrame:
    """One row for each frame: its deltas, or zeros and baseline_frame for the first, which has nothing before it."""
    first = frames.groupBy("repository").agg(F.min("frame").alias("_first"))
    every = frames.select("repository", "frame").distinct().join(first, "repository")
    both = every.join(deltas, ["repository", "frame"], "left")
    return both.select("repository", "frame", (F.col("frame") == F.col("_first")).alias("baseline_frame"), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def story(scan: DataFrame, comparison: DataFrame, drivers: DataFrame, context: DataFrame) -> DataFrame:
    """One row that joins four single-row artifacts: whether each is of the scan's commit, and a warning for a comparison or a
    context that is not.

    ``scan``: sha; ``comparison``: before_sha, after_sha; ``drivers``: after_sha; ``context``: sha.  Where a commit is not known, or
    an artifact not given, its flag is null and nothing is warned of.  Drivers of another commit are no fault:
    driver_relation says whether they are of the current commit or of a historical change point.
    """
    one = scan.select(F.col("sha").alias("scan_sha"))
    for name, df, column in (("comparison", comparison, "after_sha"), ("drivers", drivers, "after_sha"), ("context", context, "sha")):
        one = one.join(df.select(F.col(column).alias(f"{name}_sha")), F.lit(True), "left")
    match = {k: F.col("scan_sha") == F.col(f"{k}_sha") for k in ("comparison", "drivers", "context")}
    notes = F.array_compact(F.array(*[F.when(~match[k], F.concat(F.lit(f"{k} is of "), f"{k}_sha", F.lit(", scan of "), "scan_sha")) for k in ("comparison", "context")]))
    relation = F.when(match["drivers"], "current-commit").when(~match["drivers"], "historical-change-point")
    return one.select("scan_sha", *[m.alias(f"{k}_matches") for k, m in match.items()], relation.alias("driver_relation"), notes.alias("warnings"))
