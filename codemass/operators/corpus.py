"""The measurement corpus: fingerprints, distances, neighbours and position in a cohort.

A fingerprint row has repository, sha, scanned_at, seq, model, canonical, identity, code_shares and symbol_shares
(arrays over the twelve categories), code_total, symbol_total, recursive_depth, semantic_index, far_share,
exact_coverage (null without relationships), relationship_count, scaffolding_ratio, product_share, machinery_share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.scalars import band, clean_counts, composition_distance, finite, identity_key, model_of, ordered_sum, shares
from codemass.schema import CATEGORIES

# What each dimension of the structural distance weighs, and the dimensions of a context.
WEIGHTS = {"code_composition": 0.40, "symbol_composition": 0.20, "recursive_depth": 0.15, "semantic_index": 0.10, "far_from_value": 0.10,
    "exact_coverage": 0.05}
DIMENSIONS = ("product_share", "machinery_share", "scaffolding_ratio", "recursive_depth", "semantic_index", "far_share", "exact_coverage")


def _clamped(value: Column | str, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(0.0), F.coalesce(finite(value), F.lit(0.0))))


def fingerprints(records: DataFrame) -> DataFrame:
    """Fingerprint rows of flat measurement records.

    ``records``: repository, sha, scanned_at, seq, version, revision, canonical, model (may be null), category_lines and
    category_symbols (maps), relationship_count, exact_resolution_rate, max_recursive_depth, semantic_index,
    far_share, scaffolding_ratio, product_share, machinery_share.  Junk counts are 0; shares are clamped.
    """
    code, symbols = clean_counts(F.col("category_lines")), clean_counts(F.col("category_symbols"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x).cast("long")
    links = F.greatest(F.lit(0), F.coalesce(finite("relationship_count"), F.lit(0.0)).cast("long"))
    return records.withColumns({"_code": code, "_symbols": symbols}).select(
        "repository", "sha", "scanned_at", "seq", F.coalesce("model", model_of("version")).alias("model"), "canonical",
        identity_key("repository", "sha", "version", "revision").alias("identity"),
        shares(F.col("_code")).alias("code_shares"), add(F.col("_code")).alias("code_total"),
        shares(F.col("_symbols")).alias("symbol_shares"), add(F.col("_symbols")).alias("symbol_total"),
        F.greatest(F.lit(0), F.coalesce(finite("max_recursive_depth"), F.lit(0.0)).cast("int")).alias("recursive_depth"),
        _clamped("semantic_index", 100.0).alias("semantic_index"), _clamped("far_share", 1.0).alias("far_share"),
        F.when(links > 0, finite("exact_resolution_rate")).alias("exact_coverage"), links.alias("relationship_count"),
        finite("scaffolding_ratio").alias("scaffolding_ratio"), _clamped("product_share", 1.0).alias("product_share"),
        _clamped("machinery_share", 1.0).alias("machinery_share"),
    )


def distance_parts(q: str = "q", c: str = "c") -> dict[str, Column]:
    """Each dimension's distance between two aliased fingerprints; null where a side lacks it."""
    x = lambda side, name: F.col(f"{side}.{name}")
    deep = lambda side: x(side, "recursive_depth") / (x(side, "recursive_depth") + 3.0)
    return {
        "code_composition": F.when((x(q, "code_total") > 0) & (x(c, "code_total") > 0), composition_distance(x(q, "code_shares"), x(c, "code_shares"))),
        "symbol_composition": F.when((x(q, "symbol_total") > 0) & (x(c, "symbol_total") > 0),
            composition_distance(x(q, "symbol_shares"), x(c, "symbol_shares"))),
        "recursive_depth": F.abs(deep(q) - deep(c)),
        "semantic_index": F.abs(x(q, "semantic_index") - x(c, "semantic_index")) / 100.0,
        "far_from_value": F.abs(x(q, "far_share") - x(c, "far_share")),
        "exact_coverage": F.abs(x(q, "exact_coverage") - x(c, "exact_coverage")),
    }


def structural_distance(q: str = "q", c: str = "c") -> Column:
    """struct<distance, components: array<struct<dimension, distance, weight, effective_weight, contribution>>>.

    The weights of dimensions that either side lacks are shared out among the others.
    """
    parts = distance_parts(q, c)
    total = ordered_sum([F.when(d.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, d in parts.items()])
    each = {k: (F.lit(WEIGHTS[k]) / total) for k in parts}
    distance = ordered_sum([F.coalesce(d * each[k], F.lit(0.0)) for k, d in parts.items()])
    rows = F.array_compact(F.array(*[
        F.when(d.isNotNull(), F.struct(F.lit(k).alias("dimension"), d.alias("distance"), F.lit(WEIGHTS[k]).alias("weight"),
                        each[k].alias("effective_weight"), (d * each[k]).alias("contribution")))
        for k, d in parts.items()
    ]))
    return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance)).alias("distance"), rows.alias("components"))


#: Shards that a corpus is dealt to where stated queries meet it.
SHARDS = 64


def compared(queries: DataFrame, corpus: DataFrame, *, same_repository: bool = False, cross_model: bool = False) -> DataFrame:
    """Every stated query (alias q) with every record (alias c) that may be its neighbour, and ``d``, their distance.

    The records are dealt to SHARDS by their identity, so that a model that most records have is not in one task, and the queries
    go to every shard; they join by shard and, unless ``cross_model``, by model and canonical setting.
    """
    dealt = queries.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))).alias("q")
    records = corpus.where("code_shares is not null").withColumn("_s",
        F.pmod(F.xxhash64("identity", "scanned_at", "seq"), F.lit(SHARDS)).cast("int")).alias("c")
    on = F.col("c._s") == F.col("q._s")
    if not cross_model:
        on = on & (F.col("c.model") == F.col("q.model")) & F.col("c.canonical").eqNullSafe(F.col("q.canonical"))
    other = ~F.coalesce(F.col("c.identity") == F.col("q.identity"), F.lit(False))
    if not same_repository:
        other = other & ~F.coalesce(F.lower("c.repository") == F.lower("q.repository"), F.lit(False))
    return records.join(dealt, on).where(other).withColumn("d", structural_distance())


def neighbours(queries: DataFrame, corpus: DataFrame, *, keep: int = 10, **options) -> DataFrame:
    """(query, repository, sha, distance, rank): the nearest repositories of each query, each by its closest record; a top-k report."""
    found = compared(queries, corpus, **options)
    rows = found.select(F.col("q.identity").alias("query"), F.col("c.repository").alias("repository"), F.col("c.sha").alias("sha"),
        F.col("d.distance").alias("distance"))
    best = rows.groupBy("query", F.lower("repository").alias("_r")).agg(F.min(F.struct("distance", "repository", "sha")).alias("b"))
    order = W.partitionBy("query").orderBy("distance", "repository", "sha")
    return best.select("query", "b.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def exclusions(queries: DataFrame, corpus: DataFrame, *, same_repository: bool = False, cross_model: bool = False) -> DataFrame:
    """(query, reason, records): how many records each reason keeps out, the first that fits.

    ``invalid``: without code shares; then ``same_identity``, ``same_repository`` and ``measurement_mismatch``.  Counted from
    the corpus's totals by identity, repository and model; no query meets a record.
    """
    setting = [F.col("model").alias("_model"), F.col("canonical").alias("_canonical")]
    total = F.sum("_n")
    cells = corpus.where("code_shares is not null").groupBy("identity", F.lower("repository").alias("_r"), *setting).agg(F.count("*").alias("_n"))
    numbered = queries.withColumn("_q", F.monotonically_increasing_id())
    asked = checkpointed(numbered.select("_q", "identity", F.lower("repository").alias("_own"), "model", "canonical"))
    fits = (F.col("_model") == F.col("model")) & F.col("_canonical").eqNullSafe(F.col("canonical"))
    counts = lambda rows, name: rows.groupBy("_q").agg(total.alias(name), F.sum(F.when(fits, F.col("_n")).otherwise(0)).alias(f"{name}_fit"))
    by_id = asked.join(cells, "identity")
    by_repository = asked.join(cells.groupBy("_r", "_model", "_canonical").agg(total.alias("_n")), F.col("_own") == F.col("_r"))
    by_setting = asked.join(cells.groupBy("_model", "_canonical").agg(total.alias("_n")), fits)
    rows = asked.select("_q", "identity")
    for frame, name in ((by_id, "_id"), (by_id.where("_own = _r"), "_both"), (by_repository, "_repo"), (by_setting, "_set")):
        rows = rows.join(counts(frame, name), "_q", "left")
    rows = rows.fillna(0)
    valid = F.coalesce(cells.agg(total.alias("n")).scalar(), F.lit(0))
    invalid = corpus.where("code_shares is null").agg(F.count("*").alias("n")).scalar()
    own = F.lit(0) if same_repository else F.col("_repo") - F.col("_both")
    own_fit = F.lit(0) if same_repository else F.col("_repo_fit") - F.col("_both_fit")
    wrong = F.lit(0) if cross_model else valid - F.col("_id") - own - (F.col("_set") - F.col("_id_fit") - own_fit)
    reasons = {"invalid": invalid, "same_identity": F.col("_id"), "same_repository": own, "measurement_mismatch": wrong}
    each = F.array(*[F.struct(F.lit(k).alias("reason"), n.cast("long").alias("records")) for k, n in reasons.items()])
    flat = rows.select(F.col("identity").alias("query"), F.explode(each).alias("e")).select("query", "e.*")
    return flat.groupBy("query", "reason").agg(F.sum("records").alias("records")).where("records > 0")


def category_differences(q: str = "q", c: str = "c", keep: int = 5) -> Column:
    """The largest differences of code shares: array<struct<category, query, candidate, delta>>."""
    rows = F.array(*[
        F.struct((-F.abs(F.col(f"{c}.code_shares")[k] - F.col(f"{q}.code_shares")[k])).alias("o"), F.lit(name).alias("category"),
                F.col(f"{q}.code_shares")[k].alias("query"), F.col(f"{c}.code_shares")[k].alias("candidate"))
        for k, name in enumerate(CATEGORIES)
    ])
    return F.transform(F.slice(F.array_sort(rows), 1, keep),
        lambda r: F.struct(r["category"].alias("category"), r["query"].alias("query"), r["candidate"].alias("candidate"),
            (r["candidate"] - r["query"]).alias("delta")))


def latest(records: DataFrame, *, key: Column | str = "repository") -> DataFrame:
    """The last record of each repository (in any letter case) by scanned_at, then by seq."""
    name = F.lower(F.col(key) if isinstance(key, str) else key)
    top = records.groupBy(name.alias("_k")).agg(F.max_by(F.struct(*records.columns), F.struct("scanned_at", "seq")).alias("r"))
    return top.select("r.*")


def newest_match(records: DataFrame, repository: Column, sha: Column | None = None) -> DataFrame:
    """The newest record of one repository, pinned to a sha if one is given."""
    hit = F.lower("repository") == F.lower(repository)
    if sha is not None:
        hit = hit & (F.lower("sha") == F.lower(sha))
    top = records.where(hit).agg(F.max_by(F.struct(*records.columns), F.struct("scanned_at", "seq")).alias("r"))
    return top.where("r is not null").select("r.*")


def _long(rows: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), finite(d).alias("value")) for d in DIMENSIONS])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.dimension", "p.value")


#: Buckets of a cohort's range.
RANGES = 512


def context(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query, dimension, value, percentile, band, cohort_size, minimum, median, maximum, reason) of each query.

    The cohort is each repository's latest record of the query's model and canonical setting, the query's own one too.
    The percentile is mid-rank; the median is the upper one.  reason tells why a dimension has no position.
    Positions are counted over sorted distinct values in RANGES buckets of a cohort's range, so a cohort is never in one task.
    """
    by = ["model", "canonical", "dimension"]
    peers = _long(latest(records).where("model is not null"), ["model", "canonical"]).where("value is not null")
    values = checkpointed(peers.groupBy(*by, "value").agg(F.count("*").alias("n")))
    stats = values.groupBy(*by).agg(F.sum("n").alias("cohort_size"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    # two levels: sums over buckets of a cohort's range, then sorted values within each bucket
    width = F.col("maximum") - F.col("minimum")
    bucket = F.when(width > 0, F.floor((F.col("value") - F.col("minimum")) / width * RANGES)).otherwise(F.lit(0))
    spread = values.join(stats, by).withColumn("_b", bucket)

    def ahead(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*by, "_b").agg(F.sum("n").alias("_n"))
        return sums.select(*by, "_b", (F.sum("_n").over(W.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_ahead"))

    within = W.partitionBy(*by, "_b").orderBy("value")
    placed = spread.withColumn("_in", F.sum("n").over(within) - F.col("n")).join(ahead(spread), [*by, "_b"]).withColumn("below", F.col("_ahead") + F.col("_in"))
    middle = F.floor(F.col("cohort_size") / 2)
    medians = placed.where((F.col("below") <= middle) & (middle < F.col("below") + F.col("n"))).select(*by, F.col("value").alias("median"),
        "cohort_size", "minimum", "maximum")
    asked = _long(queries.withColumn("query", F.col("identity")), ["query", "model", "canonical"])
    sized = asked.join(medians, by, "left")
    # a query's values take their places among the cohort's
    asks = sized.where("value is not null and cohort_size is not null").select(*by, bucket.alias("_b"), "value", F.lit(0).cast("long").alias("n"), "query")
    rows = spread.select(*by, "_b", "value", "n", F.lit(None).cast("string").alias("query")).unionByName(asks)
    upto = within.rangeBetween(W.unboundedPreceding, W.currentRow)
    spots = rows.withColumns({"_upto": F.sum("n").over(upto), "_equal": F.sum("n").over(W.partitionBy(*by, "_b", "value"))}).where("query is not null")
    spots = spots.join(ahead(rows), [*by, "_b"]).select("query", "dimension", (F.col("_ahead") + F.col("_upto") - F.col("_equal")).alias("_below"), "_equal")
    ranked = sized.join(spots.distinct(), ["query", "dimension"], "left")
    percentile = 100.0 * (F.col("_below") + 0.5 * F.col("_equal")) / F.col("cohort_size")
    known = F.col("value").isNotNull() & F.col("cohort_size").isNotNull()
    return ranked.withColumn("percentile", F.when(known, percentile)).select(
        "query", "dimension", "value", "percentile", F.when(known, band("percentile", "cohort_size")).alias("band"),
        *[F.when(known, F.col(c)).alias(c) for c in ("cohort_size", "minimum", "median", "maximum")],
        F.when(F.col("value").isNull(), "query evidence unavailable").when(F.col("cohort_size").isNull(), "cohort evidence unavailable").alias("reason"),
    )


def skip_known(targets: DataFrame, corpus: DataFrame, *, refresh: bool = False) -> DataFrame:
    """Targets whose identity no successful record has yet; all of them to refresh."""
    if refresh:
        return targets
    return targets.join(corpus.where("status = 'ok'").select("identity").distinct(), "identity", "left_anti")


def distinct_targets(targets: DataFrame) -> DataFrame:
    """The first target of each repository and sha, in any letter case; null shas are alike."""
    keys = [F.lower("repository"), F.lower(F.coalesce("sha", F.lit("")))]
    return targets.groupBy(*[k.alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*targets.columns), "seq").alias("t")).select("t.*")


def with_overrides(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Targets with the shas that overrides (repository, sha) name; overrides of no target become targets.

    Two different shas for one repository fail the job.
    """
    named = overrides.groupBy(F.lower("repository").alias("_k")).agg(F.min("repository").alias("_r"), F.min("sha").alias("_a"), F.max("sha").alias("_b"))
    sure = named.select("_k", "_r", F.when(F.lower("_a") == F.lower("_b"),
            F.col("_a")).otherwise(F.raise_error(F.concat(F.lit("conflicting sha overrides for "), F.col("_r")))).alias("_sha"))
    both = targets.withColumn("_k", F.lower("repository")).join(sure, "_k", "full_outer")
    clash = F.col("sha").isNotNull() & F.col("_sha").isNotNull() & (F.lower("sha") != F.lower("_sha"))
    sha = F.when(clash, F.raise_error(F.concat(F.lit("conflicting sha for "), F.col("repository")))).otherwise(F.coalesce("_sha", "sha"))
    return both.select(F.coalesce("repository", "_r").alias("repository"), sha.alias("sha"), *[c for c in targets.columns if c not in ("repository", "sha")])


def diagnostics_rollup(diagnostics: DataFrame, *, by: str = "snapshot_id", samples: int = 25) -> DataFrame:
    """(by, severity, n, samples): counts, and the first messages by path."""
    order = W.partitionBy(by, "severity").orderBy("path", "message")
    first = diagnostics.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= samples)
    kept = first.groupBy(by, "severity").agg(F.array_sort(F.collect_list(F.struct("_k", "path", "message"))).alias("_s"))
    counts = diagnostics.groupBy(by, "severity").agg(F.count("*").alias("n"))
    return counts.join(kept, [by, "severity"]).select(by, "severity", "n",
        F.transform("_s", lambda s: F.concat_ws(": ", s["path"], s["message"])).alias("samples"))


def explanation(q: str = "q", c: str = "c", d: str = "d") -> Column:
    """The lines that tell a neighbour's distance in words."""
    part = lambda name: F.try_element_at(F.filter(F.col(f"{d}.components"), lambda p: p["dimension"] == name), F.lit(1))["distance"]
    code, symbols = part("code_composition"), part("symbol_composition")
    a, b = F.col(f"{q}.recursive_depth"), F.col(f"{c}.recursive_depth")
    return F.array_compact(F.array(
        F.when(code.isNotNull(), F.format_string("Code-purpose composition distance is %.3f.", code)).otherwise(
                "Code-purpose composition was unavailable for at least one scan and was excluded from distance weighting."),
        F.when(symbols.isNotNull(), F.format_string("Symbol-role composition distance is %.3f.", symbols)).otherwise(
                "Symbol-role composition was unavailable for at least one scan and was excluded from distance weighting."),
        F.when(a == b, F.format_string("Both scans have exact recursive depth %d.", a)).otherwise(
                F.format_string("Exact recursive depth differs: %d versus %d.", a, b)),
        F.format_string("Semantic Index differs by %+.1f points; this is structural context, not a quality judgment.",
                F.col(f"{c}.semantic_index") - F.col(f"{q}.semantic_index")),
        F.when(part("exact_coverage").isNull(), "Exact relationship coverage was unavailable for at least one scan and was excluded from distance weighting."),
    ))
