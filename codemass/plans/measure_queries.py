"""Queries of composition metrics, profiles and the measurement corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.operators import classify, compare, corpus, metrics, nearest
from codemass.plans.proxies import frame
from codemass.schema import ASSURANCE, AUDIT, CATEGORIES, ESSENTIAL, MACHINERY, PRODUCT


def _in(group: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in group) + ")"


_INDEX = "100.0 * least(1.0, 0.40::double * {a} + 0.25::double * {m} * 2.0 + 0.20::double * {f} + 0.15::double * least({d} / 6.0::double, 1.0::double))"
_LINES = "coalesce(sum(code_lines) filter ({}), 0)::bigint"


def composition_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Line sums, shares and the index of all components."""
    return metrics.composition(frame(spark, sf, "components"))


def category_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each category."""
    return metrics.category_lines(frame(spark, sf, "components"))


def directory_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every folder's profile."""
    return metrics.directory_profiles(frame(spark, sf, "components"))


_PROFILES = f"""
select snapshot_id, path, sum(code_lines)::bigint code_lines, {_LINES.format("category in " + _in(PRODUCT))} product_lines,
 {_LINES.format("category in " + _in(ESSENTIAL))} essential_lines, {_LINES.format("category in " + _in(MACHINERY))} machinery_lines
from (select snapshot_id, category, code_lines, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2),
  split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) path from {{components}} where category <> 'documentation')
group by snapshot_id, path having sum(code_lines) >= 10"""
_PROFILED = f"""select *, machinery_lines / code_lines tooling_share, case when product_lines > 0 then machinery_lines / product_lines when machinery_lines > 0 then null else 0.0::double end scaffolding_ratio,
 product_lines > 0 and machinery_lines > product_lines is_inversion from ({_PROFILES})"""


def inversion_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve folders where machinery most exceeds product."""
    rows = directory_profiles(spark, sf).where("is_inversion").withColumn("excess", F.col("machinery_lines") - F.col("product_lines"))
    return rows.orderBy(F.desc("excess"), F.desc("scaffolding_ratio"), "path").limit(12).select("path", "excess", "scaffolding_ratio")


def component_order_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest components of each category."""
    order = W.partitionBy("category").orderBy(F.desc("code_lines"), "path")
    ranked = frame(spark, sf, "components").withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    return ranked.select("category", "rank", "path", "code_lines")


def fingerprint_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each purpose's share in all lines."""
    return metrics.anatomy_fingerprint(frame(spark, sf, "components"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Measurement records of nations by year."""
    rows = frame(spark, sf, "measured")
    by = ["repository", "sha", "frame"]
    as_map = lambda key: F.map_from_entries(F.collect_list(F.struct(key, "n")))
    code = rows.groupBy(*by, "category").agg(F.sum("n").alias("n"),
        F.max("scanned_at").alias("at")).groupBy(*by).agg(as_map("category").alias("category_lines"), F.max("at").alias("scanned_at"),
        F.sum("n").alias("total"))
    roles = rows.groupBy(*by, "role").agg(F.sum("n").alias("n")).groupBy(*by).agg(as_map("role").alias("category_symbols"))
    product = F.coalesce(F.try_element_at("category_lines", F.lit("core-product")),
        F.lit(0)) + F.coalesce(F.try_element_at("category_lines", F.lit("user-surface")), F.lit(0))
    machine = F.coalesce(F.try_element_at("category_lines", F.lit("testing")),
        F.lit(0)) + F.coalesce(F.try_element_at("category_lines", F.lit("process-machinery")), F.lit(0))
    links = F.when(F.col("frame") % 3 == 0, F.lit(0)).otherwise(F.col("total"))
    return code.join(roles, by).select(
        "repository", "sha", "frame", "scanned_at", F.col("frame").alias("seq"),
        F.when(F.col("frame") == 1995, "0.13.0").otherwise("0.10.2").alias("version"), F.lit("r1").alias("revision"),
        F.lit(True).alias("canonical"), F.lit(None).cast("string").alias("model"), "category_lines", "category_symbols", links.alias("relationship_count"),
        (product / F.col("total")).alias("exact_resolution_rate"), (F.col("total") % 7).alias("max_recursive_depth"),
        (F.col("total") % 90 + 0.5).alias("semantic_index"),
        (machine / F.col("total") / 2.0).alias("far_share"), F.when(product > 0, machine / product).alias("scaffolding_ratio"),
        (product / F.col("total")).alias("product_share"), (machine / F.col("total")).alias("machinery_share"),
    )


_COUNT = lambda key, values: ", ".join(f"coalesce(sum(n) filter ({key} = '{c}'), 0)::double as {key[0]}{k}" for k, c in enumerate(values))
_RECORDS = f"""
select *, pr / total product_share, ma / total machinery_share, case when pr > 0 then ma / pr end scaffolding_ratio, case when frame % 3 = 0 then 0 else total end relationship_count,
 case when frame % 3 <> 0 then pr / total end exact_coverage, (total % 7)::int recursive_depth, total % 90 + 0.5::double semantic_index, ma / total / 2.0::double far_share,
 case when frame = 1995 then null else 'semantic-v1' end model, repository || ':' || sha || ':' || case when frame = 1995 then '0.13.0' else '0.10.2' end || ':r1' as identity
from (select repository, sha, frame, max(scanned_at) scanned_at, sum(n)::bigint total, {_COUNT("category", CATEGORIES)}, {_COUNT("role", CATEGORIES)},
 (coalesce(sum(n) filter (category in ('core-product', 'user-surface')), 0))::bigint pr, (coalesce(sum(n) filter (category in ('testing', 'process-machinery')), 0))::bigint ma
 from {{measured}} group by repository, sha, frame)"""


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all records, made once for both sides of a comparison."""
    return checkpointed(corpus.fingerprints(_records(spark, sf)))


def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of every record, shares flat."""
    p = _prints(spark, sf)
    flat = [F.col("code_shares")[k].alias(f"code_{k}") for k in range(12)] + [F.col("symbol_shares")[k].alias(f"symbol_{k}") for k in range(12)]
    return p.select("identity", "model", "code_total", "symbol_total", "recursive_depth", "semantic_index", "far_share", "exact_coverage",
        "scaffolding_ratio", *flat)


_SUMS = "(" + " + ".join(f"c{k}" for k in range(12)) + ")", "(" + " + ".join(f"r{k}" for k in range(12)) + ")"
_FLAT = ", ".join([f"c{k} / {_SUMS[0]} code_{k}" for k in range(12)] + [f"r{k} / {_SUMS[1]} symbol_{k}" for k in range(12)])
_FINGER = f"select identity, model, {_SUMS[0]}::bigint code_total, {_SUMS[1]}::bigint symbol_total, recursive_depth, semantic_index, far_share, exact_coverage, scaffolding_ratio, {_FLAT} from ({_RECORDS})"
_TV = lambda s: "least(1.0::double, (" + "+ ".join(f"abs(q.{s}_{k} - c.{s}_{k})" for k in range(12)) + ") * 0.5::double)"
_DEEP = lambda s: f"({s}.recursive_depth / ({s}.recursive_depth + 3.0::double))"
_TOTAL = "(0.40::double + 0.20::double + 0.15::double + 0.10::double + 0.10::double + case when q.exact_coverage is not null and c.exact_coverage is not null then 0.05::double else 0.0::double end)"
_DISTANCE = f"""least(1.0::double, greatest(0.0::double, {_TV("code")} * (0.40::double / {_TOTAL}) + {_TV("symbol")} * (0.20::double / {_TOTAL}) + abs({_DEEP("q")} - {_DEEP("c")}) * (0.15::double / {_TOTAL})
 + abs(q.semantic_index - c.semantic_index) / 100.0::double * (0.10::double / {_TOTAL}) + abs(q.far_share - c.far_share) * (0.10::double / {_TOTAL}) + coalesce(abs(q.exact_coverage - c.exact_coverage) * (0.05::double / {_TOTAL}), 0.0::double)))"""
_FULL = f"select f.*, repository, sha, frame, scanned_at, product_share, machinery_share from ({_FINGER}) f join (select identity, repository, sha, frame, scanned_at, product_share, machinery_share from ({_RECORDS})) using (identity)"


def _queried(p: DataFrame) -> DataFrame:
    """The stated queries: records of the year 2000."""
    return p.where(F.col("seq") == 2000)


def structural_distance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of every record of 2000 from every comparable record."""
    p = _prints(spark, sf)
    rows = corpus.compared(_queried(p), p)
    return rows.select(F.col("q.identity").alias("query"), F.col("c.identity").alias("candidate"), F.round("d.distance", 9).alias("distance"))


def neighbours_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest nations of each nation of 2000."""
    p = _prints(spark, sf)
    return corpus.neighbours(_queried(p), p).select("query", "rank", "repository", "sha", F.round("distance", 9).alias("distance"))


def neighbours_all(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest nations of every nation in every year."""
    p = _prints(spark, sf)
    return nearest.nearest(p, p).select("query", "rank", "repository", "sha", F.round("distance", 9).alias("distance"))


def neighbours_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """How many records each reason keeps from being neighbours."""
    p = _prints(spark, sf)
    return corpus.exclusions(_queried(p), p)


def context_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Where each record of 2000 lies among the latest records."""
    p = _prints(spark, sf)
    return corpus.context(_queried(p), p).drop("reason")


_DIMS = ("product_share", "machinery_share", "scaffolding_ratio", "recursive_depth", "semantic_index", "far_share", "exact_coverage")
_CONTEXT = f"""
with f as ({_FULL}), latest as (select * from f qualify row_number() over (partition by lower(repository) order by scanned_at desc, frame desc) = 1),
 peers as (select * from latest where model is not null),
 q as (select identity query, unnest([{", ".join(f"'{d}'" for d in _DIMS)}]) dimension, unnest([{", ".join(f"{d}::double" for d in _DIMS)}]) v from f where frame = 2000),
 c as (select unnest([{", ".join(f"'{d}'" for d in _DIMS)}]) dimension, unnest([{", ".join(f"{d}::double" for d in _DIMS)}]) x from peers),
 s as (select dimension, count(*) n, min(x) lo, max(x) hi, list_sort(list(x))[count(*) // 2 + 1] med from c where x is not null group by 1),
 r as (select query, q.dimension, v, n, lo, med, hi, sum((x < v)::int) b, sum((x = v)::int) e from q left join s using (dimension) left join c on c.dimension = q.dimension and x is not null group by all)
select query, dimension, v as "value", case when k then p end percentile, case when k then case when n < 10 then 'insufficient-cohort' when p < 10 then 'lower-tail' when p > 90 then 'upper-tail' else 'middle-range' end end band,
 case when k then n end cohort_size, case when k then lo end minimum, case when k then med end median, case when k then hi end maximum
from (select *, v is not null and n is not null k, 100.0::double * (b + 0.5::double * e) / n p from r)"""


def latest_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of each nation."""
    return corpus.latest(_prints(spark, sf)).select("repository", "sha", "identity", "code_total")


def newest_match(spark: SparkSession, sf: str) -> DataFrame:
    """The newest record of one nation, named in other letters."""
    return corpus.newest_match(_prints(spark, sf), F.lit("nation_7")).select("repository", "sha", "identity")


def ingest_skip_known(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are no labelled ones yet: targets without a successful record."""
    targets = frame(spark, sf, "documents").select("doc_id", F.concat(F.lit("o/r"), F.col("doc_id").cast("string")).alias("identity"))
    known = frame(spark, sf, "labels").select(F.concat(F.lit("o/r"), F.col("doc_id").cast("string")).alias("identity"),
        F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return corpus.skip_known(targets, known).select("doc_id", "identity")


def target_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Targets by language and source, the first of each."""
    d = frame(spark, sf, "documents")
    rows = d.select(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("repository"),
        F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("sha"), F.col("doc_id").alias("seq"))
    return corpus.distinct_targets(rows)


def target_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as targets, customers' segments as overrides."""
    targets = frame(spark, sf, "nation").select(F.col("n_name").alias("repository"), F.lit(None).cast("string").alias("sha"), F.col("n_nationkey").alias("seq"))
    named = frame(spark, sf, "customer").where("c_nationkey % 2 = 0").select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("repository"),
        F.concat(F.lit("sha"), F.col("c_nationkey").cast("string")).alias("sha"))
    extra = frame(spark, sf, "region").select(F.lower("r_name").alias("repository"), F.lit("shaR").alias("sha"))
    return corpus.with_overrides(targets, named.union(extra))


def override_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The declared category of each component by brand and by brand and type."""
    parts = frame(spark, sf, "part")
    brand = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    rules = parts.where("p_partkey % 4 = 0").select(brand.alias("prefix"), F.lit("testing").alias("category")).union(
        parts.where("p_partkey % 6 = 0").select(F.concat(brand, F.lit("/"), F.lower("p_type"), F.lit("/")).alias("prefix"),
            F.lit("verification").alias("category"))
    )
    return classify.declared(frame(spark, sf, "components").select("snapshot_id", "path"), rules.distinct()).select("path", "declared")


def diagnostics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Events as diagnostics: counts by severity and the first 25 messages."""
    e = frame(spark, sf, "events").select(
        F.lit("events").alias("snapshot_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"),
    )
    return corpus.diagnostics_rollup(e).select("severity", "n", F.array_join("samples", "|").alias("samples"))


def identity_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between each nation's neighbouring measurements."""
    rows = _records(spark, sf).select("repository", "frame", "version", "sha", F.when(F.col("frame") % 2 == 0, F.col("repository")).alias("source"),
        (F.col("frame") % 3 > 0).alias("canonical"))
    both = rows.alias("before").join(rows.alias("after"),
        (F.col("before.repository") == F.col("after.repository")) & (F.col("after.frame") == F.col("before.frame") + 1))
    return both.select(F.col("after.repository").alias("repository"), F.col("after.frame").alias("frame"),
        *[c.alias(k) for k, c in compare.identity_flags().items()])


def unknown_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Brands and types whose components are of unknown purpose for over a fifth of the lines."""
    c = frame(spark, sf, "components").withColumn("snapshot_id", F.concat_ws("/", F.split("path", "/")[1], F.split("path", "/")[2]))
    return metrics.composition_warnings(c).select("snapshot_id")


_METRICS = f"""
select *, direct_product_share * 0 + {_INDEX.format(a="audit_ratio", m="meta_machinery_share", f="far_from_value_share", d="max_audit_depth")} recursion_index from (
select *, product_lines / total_lines direct_product_share, essential_lines / total_lines product_plus_essential_share, machinery_lines / total_lines tooling_share, meta_lines / total_lines meta_machinery_share,
 assurance_lines / essential_lines assurance_ratio, audit_lines / total_lines audit_ratio, machinery_lines / product_lines scaffolding_ratio, far_lines / total_lines far_from_value_share from (
select snapshot_id, {_LINES.format("category <> 'documentation'")} total_lines, {_LINES.format("category in " + _in(PRODUCT))} product_lines, {_LINES.format("category in " + _in(ESSENTIAL))} essential_lines,
 {_LINES.format("category in " + _in(MACHINERY))} machinery_lines, {_LINES.format("category in " + _in(ASSURANCE))} assurance_lines, {_LINES.format("category in " + _in(AUDIT))} audit_lines,
 {_LINES.format("category = 'meta-machinery'")} meta_lines, {_LINES.format("category <> 'documentation' and value_distance >= 4")} far_lines, 0::int max_audit_depth from {{components}} group by snapshot_id))"""

_NEIGHBOURS = f"""with f as ({_FULL}), p as (select q.identity query, c.repository, c.sha, {_DISTANCE} d from f q, f c where {{only}} lower(q.repository) <> lower(c.repository) and c.model = q.model),
 b as (select * from p qualify row_number() over (partition by query, repository order by d, sha) = 1)
select query, row_number() over (partition by query order by d, repository, sha)::int as "rank", repository, sha, round(d, 9) distance from b qualify row_number() over (partition by query order by d, repository, sha) <= 10"""

QUERIES = {
    "composition_metrics": (composition_metrics, _METRICS.replace("direct_product_share * 0 + ", "")),
    "category_lines": (category_lines, "select snapshot_id, category, sum(code_lines)::bigint code_lines from {components} group by 1, 2"),
    "directory_profiles": (directory_profiles, _PROFILED),
    "inversion_topk": (inversion_topk, f"select path, machinery_lines - product_lines excess, scaffolding_ratio from ({_PROFILED}) where is_inversion order by 2 desc, 3 desc, 1 limit 12"),
    "component_order_topk": (component_order_topk,
        'select category, row_number() over (partition by category order by code_lines desc, path)::int as "rank", path, code_lines from {components} qualify row_number() over (partition by category order by code_lines desc, path) <= 20'),
    "fingerprint_shares": (fingerprint_shares, f"select snapshot_id, k category, coalesce(sum(code_lines) filter (category = k), 0)::bigint / sum(code_lines)::bigint share from {{components}}, (select unnest([{', '.join(repr(c) for c in CATEGORIES[:10])}]) k) group by 1, 2"),
    "corpus_fingerprint": (corpus_fingerprint, _FINGER),
    "structural_distance_pairs": (structural_distance_pairs,
        f"with f as ({_FULL}) select q.identity query, c.identity candidate, round({_DISTANCE}, 9) distance from f q, f c where q.frame = 2000 and lower(q.repository) <> lower(c.repository) and c.model = q.model"),
    "neighbours_topk": (neighbours_topk, _NEIGHBOURS.replace("{only}", "q.frame = 2000 and")),
    "neighbours_all": (neighbours_all, _NEIGHBOURS.replace("{only}", "")),
    "neighbours_exclusions": (neighbours_exclusions,
        f"""with f as ({_FULL}) select q.identity query, case when c.identity = q.identity then 'same_identity' when c.repository = q.repository then 'same_repository' else 'measurement_mismatch' end reason, count(*) records
from f q, f c where q.frame = 2000 and (c.repository = q.repository or c.model is null) group by 1, 2"""),
    "context_percentiles": (context_percentiles, _CONTEXT),
    "latest_per_repo": (latest_per_repo, f"select repository, sha, identity, code_total from ({_FULL}) qualify row_number() over (partition by repository order by scanned_at desc, frame desc) = 1"),
    "newest_match": (newest_match, f"select repository, sha, identity from ({_FULL}) where repository = 'NATION_7' order by scanned_at desc, frame desc limit 1"),
    "ingest_skip_known": (ingest_skip_known, "select doc_id, 'o/r' || doc_id as identity from {documents} where doc_id not in (select doc_id from {labels} where quality = 1)"),
    "target_dedup": (target_dedup, "select repository, sha, seq from (select case when doc_id % 2 = 0 then upper(lang) else lang end repository, case when doc_id % 5 > 0 then source end sha, doc_id seq from {documents}) qualify row_number() over (partition by lower(repository), coalesce(sha, '') order by seq) = 1"),
    "target_overrides": (target_overrides, """select coalesce(n_name, r) repository, s sha, n_nationkey seq from {nation} full join (select distinct 'nation_' || c_nationkey r, 'sha' || c_nationkey s from {customer} where c_nationkey % 2 = 0
 union all select lower(r_name), 'shaR' from {region}) on lower(n_name) = r"""),
    "override_longest_prefix": (override_longest_prefix,
        """with p as (select path, 'src/' || split_part(path, '/', 2) b, 'src/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) t, p_partkey from {components})
select path, case when t in (select t from p where p_partkey % 6 = 0) then 'verification' else 'testing' end declared from p
where t in (select t from p where p_partkey % 6 = 0) or b in (select b from p where p_partkey % 4 = 0)"""),
    "diagnostics_rollup": (diagnostics_rollup, """select severity, n, string_agg(path || ': ' || message, '|' order by k) samples from (select *, count(*) over (partition by severity) n, row_number() over (partition by severity order by path, message) k from (
 select 'u' || user_id path, case event_type when 'error' then 'error' when 'view' then 'warning' else 'info' end severity, 'm' || event_id message from {events})) where k <= 25 group by severity, n"""),
    "identity_flags": (identity_flags, f"""with r as (select repository, frame, case when frame = 1995 then '0.13.0' else '0.10.2' end v, sha, case when frame % 2 = 0 then repository end s, frame % 3 > 0 c from ({_RECORDS}))
select b.repository, b.frame, a.v <> b.v analyzer_version_changed, coalesce(a.s <> b.s, false) analyzer_source_changed, a.c <> b.c canonical_setting_changed, a.sha <> b.sha target_sha_changed,
 not (a.v <> b.v or coalesce(a.s <> b.s, false) or a.c <> b.c) like_for_like from r a join r b on a.repository = b.repository and b.frame = a.frame + 1"""),
    "unknown_warning": (unknown_warning, "select split_part(path, '/', 2) || '/' || split_part(path, '/', 3) snapshot_id from {components} where category <> 'documentation' group by 1 having coalesce(sum(code_lines) filter (category = 'unknown'), 0) / sum(code_lines) > 0.2"),
}
