"""Queries of the bounded selections that reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.functions import scalars, text
from codemass.operators import compare, corpus, metrics, select, surfaces
from codemass.plans import explore, measure_queries, series_queries
from codemass.plans.proxies import frame
from codemass.schema import CATEGORIES, MACHINERY
from codemass.sources import parse

_MACHINE = "category in (" + ", ".join(f"'{c}'" for c in MACHINERY) + ")"


def file_explorer(spark: SparkSession, sf: str) -> DataFrame:
    """The 160 components most worth a look."""
    return explore.file_explorer(frame(spark, sf, "components")).select("rank", "path", "category", "value_distance")


def symbol_explorer(spark: SparkSession, sf: str) -> DataFrame:
    """The 180 symbols most worth a look."""
    s = frame(spark, sf, "symbols").withColumn("value_distance", F.col("start_line") % 7)
    return explore.symbol_explorer(s).select("rank", "id", "value_distance")


def folder_files(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 longest components below every folder."""
    return explore.folder_files(frame(spark, sf, "components")).select("folder", "rank", "path", "code_lines")


def file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The first 30 symbols of every file."""
    return explore.file_symbols(frame(spark, sf, "symbols")).select("path", "rank", "id")


def representative_inversions(spark: SparkSession, sf: str) -> DataFrame:
    """The five sharpest inversions of every brand."""
    c = frame(spark, sf, "components").withColumn("snapshot_id", F.split("path", "/")[1])
    p = metrics.directory_profiles(c)
    return explore.representative_inversions(p).select("snapshot_id", "rank", "path", "scaffolding_ratio")


def layout_order(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty most notable layout changes."""
    before, after = (s.withColumn("weight", F.col("code_lines")) for s in series_queries._files(spark, sf))
    return explore.layout_order(compare.layout_changes(before, after, ("snapshot_id",)), ["snapshot_id"]).select("rank", "path", "weight_delta")


def metabolism_order(spark: SparkSession, sf: str) -> DataFrame:
    """The 160 files of the last day by status and length."""
    return explore.metabolism_order(series_queries.status(spark, sf)).select("rank", "path", "status", "code_lines")


def baseline_frames(spark: SparkSession, sf: str) -> DataFrame:
    """How many nations crossed over in each quarter; the first quarter is the baseline."""
    p = series_queries._profiles(spark, sf)
    n = compare.crossovers(p.withColumn("frame", F.col("frame") + 1), p, ("repository", "frame")).groupBy("repository",
        "frame").agg(F.count("*").alias("crossed"))
    return explore.with_baseline(n, p, ["crossed"])


def representative_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The first five of the two-step chains of every seventeenth."""
    ids = F.array(F.concat(F.lit("s"), F.col("a").cast("string")), F.concat(F.lit("m"), F.col("b").cast("string")))
    rows = frame(spark, sf, "pairs").select(F.concat(F.lit("g"), (F.col("a") % 17).cast("string")).alias("snapshot_id"), ids.alias("symbol_ids"),
        (F.col("b") % 4).cast("int").alias("depth"))
    return explore.representative_chains(rows).select("snapshot_id", "rank", "depth", F.array_join("symbol_ids", ">").alias("chain"))


def data_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that describe data."""
    return select.data_symbols(frame(spark, sf, "symbols")).select("id", "kind")


def atlas_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the capabilities of every category have an anchor."""
    rows = frame(spark, sf, "symbols").select(F.col("category").alias("snapshot_id"), F.when(F.col("kind") != "file", F.col("id")).alias("symbol_id"))
    return surfaces.atlas_counts(rows)


def category_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The three purposes whose shares differ most between a nation's records of 1999 and 2000."""
    p = measure_queries._prints(spark, sf).where("sha in ('1999', '2000')")
    both = p.where("sha = '1999'").alias("q").join(p.where("sha = '2000'").alias("c"), F.col("q.repository") == F.col("c.repository"))
    rows = both.select(F.col("q.repository").alias("repository"), F.posexplode(corpus.category_differences(keep=3)).alias("_p", "d"))
    return rows.select("repository", (F.col("_p") + 1).alias("rank"), F.col("d.category").alias("category"), F.round("d.delta", 9).alias("delta"))


def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as paths that need cleaning, cleaned."""
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("./", "/", "", ".\\"))), (F.col("p_partkey") % 4 + 1).cast("int")),
        F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit("/"))
    return frame(spark, sf, "part").select("p_partkey", text.normal_path(raw).alias("path"))


def rating_text(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of line items in words of a rating, without trailing zeros."""
    return frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.rating((F.col("l_quantity").cast("double") / 8)).alias("rating"))


def structural_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in words between two quarters of every region."""
    p = series_queries._profiles(spark, sf).where("frame in (8, 9)")
    side = lambda f: p.where(F.col("frame") == f)
    lines = lambda f: side(f).groupBy("repository").agg(F.sum("product_lines").alias("core-product"),
        F.sum("machinery_lines").alias("testing")).unpivot("repository", ["core-product", "testing"], "category", "code_lines")
    deltas, crossed = compare.category_deltas(lines(8), lines(9), ("repository",)), compare.crossovers(side(8), side(9), ("repository",))
    deep = lambda f, name: side(f).groupBy("repository").agg((F.sum("product_lines") % 4).cast("int").alias(name))
    chains = side(9).select("repository", F.when(F.col("product_lines") % 3 == 0, "added").when(F.col("product_lines") % 3 == 1,
            "removed").otherwise("changed").alias("change"), F.col("path").alias("before"), F.col("path").alias("after"))
    return compare.structural_explanations(deltas, crossed, deep(8, "before").join(deep(9, "after"), "repository"), chains, ("repository",))


def story(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the comparison, drivers and context of the tables are of the last scan."""
    last = lambda table, column, name: frame(spark, sf, table).agg(F.max(column).cast("date").cast("string").alias(name))
    return explore.story(last("orders", "o_orderdate", "sha"), last("orders", "o_orderdate", "after_sha"),
        last("lineitem", "l_shipdate", "after_sha"), last("events", "ts", "sha")).withColumn("warnings", F.array_join("warnings", "; "))


def python_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Code lines and imports of Python files made of documents: every line of odd ones is a comment, of even ones a statement."""
    clean = lambda x: F.regexp_replace(x, "[^A-Za-z0-9 ]", "")
    line = lambda x: F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("# "), clean(x))).otherwise(F.concat(F.lit('x = "'), clean(x), F.lit('"')))
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    source = F.concat(F.lit('"""About.\n\nMore."""\nimport pkg.'), F.coalesce("lang", F.lit("none")), F.lit("\n"), body, F.lit("\n"))
    rows = frame(spark, sf, "documents").select(F.lit("docs").alias("snapshot_id"), "doc_id", F.lit("python").alias("language"), source.alias("text"),
        F.lit(0).alias("code_lines"))
    counted = parse.with_python_lines(rows)
    return counted.select("doc_id", "code_lines", F.array_join(text.imports_of("text", "language"), ",").alias("imports"))


_QUARTERS = f"with p as (select * from ({series_queries._PROFILES}) where frame in (8, 9)), s as (select repository, sum(product_lines) filter (frame = 8)::bigint a, sum(product_lines) filter (frame = 9)::bigint b, sum(machinery_lines) filter (frame = 8)::bigint c, sum(machinery_lines) filter (frame = 9)::bigint d from p group by 1)"
_LAYOUT = series_queries._LAYOUT
_STATUS = series_queries._STATUS

QUERIES = {
    "file_explorer": (file_explorer, f'select (row_number() over o)::int as "rank", path, category, value_distance from {{components}} window o as (order by {_MACHINE} desc, value_distance desc, code_lines desc, path) qualify row_number() over o <= 160'),
    "symbol_explorer": (symbol_explorer, f"select (row_number() over o)::int as \"rank\", id, (start_line % 7)::int value_distance from {{symbols}} where kind <> 'file' window o as (order by {_MACHINE} desc, start_line % 7 desc, path, start_line, qualified_name, id) qualify row_number() over o <= 180"),
    "folder_files": (folder_files, """with f as (select path, code_lines, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) folder from {components})
select folder, (row_number() over o)::int as "rank", path, code_lines from f window o as (partition by folder order by code_lines desc, path) qualify row_number() over o <= 40"""),
    "file_symbols": (file_symbols, "select path, (row_number() over o)::int as \"rank\", id from {symbols} where kind <> 'file' window o as (partition by path order by start_line, qualified_name, id) qualify row_number() over o <= 30"),
    "representative_inversions": (representative_inversions, f"""
with f as (select split_part(path, '/', 2) snapshot_id, category, code_lines, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) path from {{components}} where category <> 'documentation'),
 p as (select snapshot_id, path, sum(code_lines)::bigint n, coalesce(sum(code_lines) filter (category in ('core-product', 'user-surface')), 0)::bigint a, coalesce(sum(code_lines) filter ({_MACHINE}), 0)::bigint b from f group by 1, 2 having sum(code_lines) >= 10)
select snapshot_id, (row_number() over o)::int as "rank", path, b / a scaffolding_ratio from p where a > 0 and b > a window o as (partition by snapshot_id order by b / a desc, n desc, path) qualify row_number() over o <= 5"""),
    "layout_order": (layout_order, f'select (row_number() over o)::int as "rank", path, weight_delta from ({_LAYOUT}) window o as (order by (appeared or disappeared) desc, abs(weight_delta) desc, classification_changed desc, path) qualify row_number() over o <= 30'),
    "metabolism_order": (metabolism_order, f"select (row_number() over o)::int as \"rank\", path, status, code_lines from ({_STATUS}) window o as (order by list_position(['active', 'superseded-candidate', 'archive-candidate', 'dormant', 'bounded-orphan-candidate', 'insufficient-evidence'], status), code_lines desc, path) qualify row_number() over o <= 160"),
    "baseline_frames": (baseline_frames, f"""with p as ({series_queries._PROFILES}), c as (select b.repository, b.frame, count(*) n from p a join p b on a.repository = b.repository and a.path = b.path and b.frame = a.frame + 1 where a.product_lines > a.machinery_lines and b.machinery_lines > b.product_lines group by 1, 2)
select repository, frame, frame = min(frame) over (partition by repository) baseline_frame, coalesce(n, 0) crossed from (select distinct repository, frame from p) left join c using (repository, frame)"""),
    "representative_chains": (representative_chains,
        "select 'g' || (a % 17) snapshot_id, (row_number() over o)::int as \"rank\", (b % 4)::int depth, 's' || a || '>' || 'm' || b as chain from {pairs} window o as (partition by a % 17 order by b % 4 desc, 's' || a, 'm' || b) qualify row_number() over o <= 5"),
    "data_symbols": (data_symbols, "select id, kind from {symbols} where kind in ('class', 'type', 'interface', 'struct', 'enum')"),
    "atlas_counts": (atlas_counts, "select category snapshot_id, count(*) filter (kind <> 'file') anchored, count(*) filter (kind = 'file')::bigint unanchored from {symbols} group by 1"),
    "category_differences": (category_differences, f"""
with f as ({measure_queries._FULL}), n as (select unnest({list(CATEGORIES)!r}) category, unnest(range(12)) k),
 l as (select repository, sha, [{", ".join(f"c{k}" for k in range(12))}] c, list_sum([{", ".join(f"c{k}" for k in range(12))}]) t from ({measure_queries._RECORDS})),
 d as (select q.repository, n.category, c.c[k + 1] / c.t - q.c[k + 1] / q.t delta from l q join l c on q.repository = c.repository and q.sha = '1999' and c.sha = '2000' cross join n)
select repository, (row_number() over o)::int as "rank", category, round(delta, 9) delta from d window o as (partition by repository order by abs(delta) desc, category) qualify row_number() over o <= 3"""),
    "normal_paths": (normal_paths, r"select p_partkey, replace(p_name, ' ', '/') as path from {part}"),
    "rating_text": (rating_text, "select l_orderkey, l_linenumber, rtrim(rtrim(printf('%.6f', l_quantity::double / 8), '0'), '.') rating from {lineitem}"),
    "structural_explanations": (structural_explanations, _QUARTERS + """,
 w as (select repository, 'Core Product' category, 'core-product' k, b - a delta from s union all select repository, 'Testing', 'testing', d - c from s),
 x as (select repository, path from p group by 1, 2 having max(product_lines) filter (frame = 8) > max(machinery_lines) filter (frame = 8) and max(machinery_lines) filter (frame = 9) > max(product_lines) filter (frame = 9)),
 h as (select repository, path, product_lines % 3 m from p where frame = 9)
select repository, 0 part, (row_number() over (partition by repository order by abs(delta) desc, k))::int as "rank", category || case when delta > 0 then ' gained ' else ' lost ' end || format('{:,}', abs(delta)) || ' LOC.' as message from w where delta <> 0
union all select repository, 1, (row_number() over (partition by repository order by path))::int, path || ' crossed from product-dominant to machinery-dominant.' from x
union all select repository, 2, 1, 'Max exact recursive depth ' || case when b % 4 > a % 4 then 'increased' else 'decreased' end || ' from ' || (a % 4) || ' to ' || (b % 4) || '.' from s where a % 4 <> b % 4
union all select repository, 3, 1, 'A new deepest exact machinery chain appeared through ' || min(path) || '.' from h where m = 0 group by repository
union all select repository, 4, 1, 'A previously deepest exact machinery chain disappeared: ' || min(path) || '.' from h where m = 1 group by repository
union all select distinct repository, 5, 1, 'A deepest exact chain kept the same endpoints but changed its internal structural path.' from h where m = 2"""),
    "python_lines": (python_lines, "select doc_id, (case when doc_id % 2 = 0 then len(string_split(coalesce(text, ''), chr(10))) else 0 end + 1)::int code_lines, 'pkg.' || coalesce(lang, 'none') imports from {documents}"),
    "story": (story, """
with o as (select max(o_orderdate)::date::string s from {orders}), l as (select max(l_shipdate)::date::string s from {lineitem}), e as (select max(ts)::date::string s from {events})
select o.s scan_sha, true comparison_matches, o.s = l.s drivers_matches, o.s = e.s context_matches, case when o.s = l.s then 'current-commit' else 'historical-change-point' end driver_relation,
 concat_ws('; ', case when o.s <> e.s then 'context is of ' || e.s || ', scan of ' || o.s end) warnings from o, l, e"""),
}
