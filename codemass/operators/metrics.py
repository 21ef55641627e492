"""Composition metrics, directory profiles and the two indices, each one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.functions.scalars import optional_ratio, ratio
from codemass.functions.text import file_name
from codemass.schema import ASSURANCE, AUDIT, CATEGORIES, ESSENTIAL, MACHINERY, PRODUCT, RECURSIVE, among


def _lines(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("code_lines")).otherwise(0)).cast("long")


def composition(components: DataFrame, depths: DataFrame | None = None, *, by: str = "snapshot_id") -> DataFrame:
    """One row a snapshot: line sums, shares, ratios and the recursion index.

    Documentation is in no share.  ``depths`` has (by, max_depth) of audit chains; snapshots without any have depth 0.
    A share without a whole is 0; scaffolding_ratio is null where there is machinery but no product.
    """
    c = F.col("category")
    doc = F.coalesce(c == "documentation", F.lit(False))
    sums = components.groupBy(by).agg(
        _lines(~doc).alias("total_lines"), _lines(among(c, PRODUCT)).alias("product_lines"), _lines(among(c, ESSENTIAL)).alias("essential_lines"),
        _lines(among(c, MACHINERY)).alias("machinery_lines"), _lines(among(c, ASSURANCE)).alias("assurance_lines"),
        _lines(among(c, AUDIT)).alias("audit_lines"), _lines(c == "meta-machinery").alias("meta_lines"),
        _lines(~doc & (F.coalesce("value_distance", F.lit(0)) >= 4)).alias("far_lines"),
    )
    if depths is None:
        sums = sums.withColumn("max_audit_depth", F.lit(0))
    else:
        sums = sums.join(depths.select(by, F.col("max_depth").alias("max_audit_depth")), by, "left").withColumn("max_audit_depth",
            F.coalesce("max_audit_depth", F.lit(0)))
    out = sums.withColumns({
        "direct_product_share": ratio("product_lines", "total_lines"), "product_plus_essential_share": ratio("essential_lines", "total_lines"),
        "tooling_share": ratio("machinery_lines", "total_lines"), "meta_machinery_share": ratio("meta_lines", "total_lines"),
        "assurance_ratio": ratio("assurance_lines", "essential_lines"), "audit_ratio": ratio("audit_lines", "total_lines"),
        "scaffolding_ratio": optional_ratio("machinery_lines", "product_lines"), "far_from_value_share": ratio("far_lines", "total_lines"),
    })
    return out.withColumn("recursion_index", file_index())


def file_index(audit: str = "audit_ratio", meta: str = "meta_machinery_share", far: str = "far_from_value_share", depth: str = "max_audit_depth") -> Column:
    """The 0 to 100 index of recursion over lines."""
    deep = F.least(F.col(depth) / 6.0, F.lit(1.0))
    return 100.0 * F.least(F.lit(1.0), F.lit(0.40) * F.col(audit) + F.lit(0.25) * F.col(meta) * 2.0 + F.lit(0.20) * F.col(far) + F.lit(0.15) * deep)


def category_lines(components: DataFrame, *, by: str = "snapshot_id") -> DataFrame:
    """(by, category, code_lines): documentation included."""
    return components.groupBy(by, "category").agg(F.sum("code_lines").cast("long").alias("code_lines"))


def directory_profiles(components: DataFrame, *, max_depth: int = 3, min_lines: int = 10, by: str = "snapshot_id") -> DataFrame:
    """Each folder down to ``max_depth``: line sums, tooling_share, scaffolding_ratio, is_inversion.

    A file counts for every folder above it; documentation and files of the root count for none.  Folders of fewer
    than ``min_lines`` are left out.  A folder is an inversion if it has product and more machinery than product.
    """
    parts = F.split("path", "/")
    depth = F.least(F.lit(max_depth), F.size(parts) - 1)
    folders = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), depth), lambda d: F.array_join(F.slice(parts, 1, d), "/")))
    c = F.col("category")
    rows = components.where(~F.coalesce(c == "documentation", F.lit(False))).select(by, "category", "code_lines", F.explode(folders).alias("path"))
    sums = rows.groupBy(by, "path").agg(
        F.sum("code_lines").cast("long").alias("code_lines"), _lines(among(c, PRODUCT)).alias("product_lines"),
        _lines(among(c, ESSENTIAL)).alias("essential_lines"), _lines(among(c, MACHINERY)).alias("machinery_lines"),
    )
    return sums.where(F.col("code_lines") >= min_lines).withColumns({
        "tooling_share": ratio("machinery_lines", "code_lines"), "scaffolding_ratio": optional_ratio("machinery_lines", "product_lines"),
        "is_inversion": (F.col("product_lines") > 0) & (F.col("machinery_lines") > F.col("product_lines")),
    })


def symbol_metrics(symbols: DataFrame, edges: DataFrame, chains: DataFrame | None = None, *, by: str = "snapshot_id") -> DataFrame:
    """One row a snapshot: symbol and relationship counts, shares, rates and the semantic recursion index.

    File symbols and ``contains`` edges are not counted.  Both rates are 1 without relationships; exact_coverage is
    null then.  ``chains`` has (by, max_depth).
    """
    c = F.col("category")
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    near = F.col("value_distance")
    s = symbols.where("kind <> 'file'").groupBy(by).agg(
        F.count("*").alias("symbol_count"), count(among(c, PRODUCT)).alias("product_symbols"), count(among(c, MACHINERY)).alias("machinery_symbols"),
        count(among(c, AUDIT)).alias("audit_symbols"), count(c == "meta-machinery").alias("meta_symbols"),
        count(near.isNotNull()).alias("product_reachable_symbols"), count((near >= 4) & among(c, RECURSIVE)).alias("far_from_value_symbols"),
        F.coalesce(F.max("value_distance"), F.lit(0)).alias("max_value_distance"),
    )
    r = F.col("resolution")
    e = edges.where("kind <> 'contains'").groupBy(by).agg(
        F.count("*").alias("relationship_count"), count(r == "exact").alias("resolved_relationships"),
        count(r == "probable").alias("probable_relationships"), count(r == "unresolved").alias("unresolved_relationships"),
    )
    both = s.join(e, by, "full_outer")
    if chains is not None:
        both = both.join(chains.select(by, F.col("max_depth").alias("max_recursive_depth")), by, "left")
    else:
        both = both.withColumn("max_recursive_depth", F.lit(0))
    both = both.fillna(0)
    out = both.withColumns({
        "direct_product_symbol_share": ratio("product_symbols", "symbol_count"), "machinery_symbol_share": ratio("machinery_symbols", "symbol_count"),
        "audit_symbol_share": ratio("audit_symbols", "symbol_count"), "meta_symbol_share": ratio("meta_symbols", "symbol_count"),
        "scaffolding_symbol_ratio": optional_ratio("machinery_symbols", "product_symbols"),
        "far_from_value_symbol_share": ratio("far_from_value_symbols", "symbol_count"),
        "resolution_rate": F.when(F.col("relationship_count") > 0,
                (F.col("resolved_relationships") + F.col("probable_relationships")) / F.col("relationship_count")).otherwise(1.0),
        "exact_resolution_rate": F.when(F.col("relationship_count") > 0, F.col("resolved_relationships") / F.col("relationship_count")).otherwise(1.0),
        "exact_coverage": F.when(F.col("relationship_count") > 0, F.col("resolved_relationships") / F.col("relationship_count")),
    })
    return out.withColumn("semantic_recursion_index",
        file_index("audit_symbol_share", "meta_symbol_share", "far_from_value_symbol_share", "max_recursive_depth"))


def composition_warnings(components: DataFrame, *, by: str = "snapshot_id") -> DataFrame:
    """(by, warning) for snapshots with over 20 % of lines unknown."""
    sums = components.where("category <> 'documentation'").groupBy(by).agg(F.sum("code_lines").alias("n"), _lines(F.col("category") == "unknown").alias("u"))
    share = ratio("u", "n")
    return sums.where(share > 0.2).select(by, F.format_string("%.1f%% of code lines are of unknown purpose.", share * 100).alias("warning"))


def anatomy_fingerprint(components: DataFrame, *, by: str = "snapshot_id") -> DataFrame:
    """(by, category, share) over the ten named purposes; documentation and unknown count in the whole."""
    ten = CATEGORIES[:10]
    pairs = [x for k in ten for x in (F.lit(k), F.sum(F.when(F.col("category") == k, F.col("code_lines")).otherwise(0)))]
    sums = components.groupBy(by).agg(F.sum("code_lines").alias("_all"), F.create_map(*pairs).alias("_by"))
    return sums.select(by, "_all", F.explode("_by").alias("category", "_n")).select(by, "category", ratio("_n", "_all").alias("share"))


def names(components: DataFrame) -> DataFrame:
    """``components`` with name, the last part of the path."""
    return components.withColumn("name", file_name("path"))
