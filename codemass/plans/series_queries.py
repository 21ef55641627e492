"""Queries over frames: differences, events, layouts and use over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.operators import compare, layout, metabolism, metrics
from codemass.plans.proxies import frame
from codemass.schema import MACHINERY, PRODUCT


def _in(group: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in group) + ")"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Frames 2 and 3 of every region: lines of nations by purpose."""
    rows = frame(spark, sf, "frames")
    return rows.where("frame = 2"), rows.where("frame = 3")


def category_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each purpose before and after, by region."""
    a, b = (s.groupBy("repository", "category").agg(F.sum("code_lines").alias("code_lines")) for s in _sides(spark, sf))
    return compare.category_deltas(a, b, ("repository",))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Product and machinery lines of each nation by quarter: the folders of a region."""
    o = frame(spark, sf, "orders").join(frame(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(frame(spark, sf, "nation"),
        F.col("n_nationkey") == F.col("c_nationkey"))
    product = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    return o.groupBy(
        (F.col("n_regionkey")).cast("string").alias("repository"),
        ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int").alias("frame"), F.col("n_name").alias("path")
    ).agg(
        F.sum(F.when(product, 1).otherwise(0)).alias("product_lines"), F.sum(F.when(product, 0).otherwise(1)).alias("machinery_lines")
    ).withColumn("is_inversion", (F.col("product_lines") > 0) & (F.col("machinery_lines") > F.col("product_lines")))


_PROFILES = """
select n_regionkey::string repository, ((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1)::int frame, n_name path, count(*) filter (substring(o_orderpriority, 1, 1) in ('1', '2')) product_lines,
 count(*) filter (substring(o_orderpriority, 1, 1) not in ('1', '2')) machinery_lines from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey group by 1, 2, 3"""


def crossovers(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that turned from mostly product to mostly machinery between neighbouring quarters."""
    p = _profiles(spark, sf)
    return compare.crossovers(p.withColumn("frame", F.col("frame") + 1), p, ("repository", "frame"))


def inversion_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Inversions added and removed between neighbouring quarters."""
    p = _profiles(spark, sf)
    last = p.agg(F.max("frame").alias("m"))
    found = compare.inversion_changes(p.withColumn("frame", F.col("frame") + 1), p, ("repository", "frame"))
    return found.join(F.broadcast(last), F.col("frame") <= F.col("m")).where("frame > 0").drop("m")


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    p = _profiles(spark, sf).groupBy("repository", "frame").agg(F.sum("product_lines").alias("p"), F.sum("machinery_lines").alias("m"),
        F.sum(F.col("is_inversion").cast("long")).alias("inversion_count"))
    return p.select("repository", "frame", (F.col("p") / (F.col("p") + F.col("m"))).alias("product_share"),
        (F.col("m") / (F.col("p") + F.col("m"))).alias("machinery_share"), ((F.col("p") + F.col("m")) % 4).cast("int").alias("recursive_depth"),
        "inversion_count")


_CHECKS = f"select repository, frame, sum(product_lines) / sum(product_lines + machinery_lines) product_share, sum(machinery_lines) / sum(product_lines + machinery_lines) machinery_share, (sum(product_lines + machinery_lines) % 4)::int recursive_depth, count(*) filter (product_lines > 0 and machinery_lines > product_lines) inversion_count from ({_PROFILES}) group by 1, 2"


def history_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Shares, depth and inversions of each region by quarter."""
    return _checkpoints(spark, sf)


def history_events(spark: SparkSession, sf: str) -> DataFrame:
    """What happened to each region between neighbouring quarters."""
    return compare.history_events(_checkpoints(spark, sf), _profiles(spark, sf))


_DOM = "case when {0}.product_share > {0}.machinery_share then 'product' when {0}.machinery_share > {0}.product_share then 'machinery' else 'balanced' end"
_EVENTS = f"""
with c as ({_CHECKS}), p as ({_PROFILES}), n as (select a.repository, b.frame, {_DOM.format("a")} l, {_DOM.format("b")} r, a.recursive_depth x, b.recursive_depth y from c a join c b on a.repository = b.repository and b.frame = a.frame + 1)
select repository, frame, 'repository-dominance-shift' as "type", null as path, l as "before", r as "after" from n where l <> r
union all select repository, frame, 'recursive-depth-change', null, x::string, y::string from n where x <> y
union all select b.repository, b.frame, 'directory-crossover', b.path, a.product_lines || '/' || a.machinery_lines, b.product_lines || '/' || b.machinery_lines
 from p a join p b on a.repository = b.repository and a.path = b.path and b.frame = a.frame + 1 where a.product_lines > a.machinery_lines and b.machinery_lines > b.product_lines"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Components before and after: sizes and purposes moved by their number."""
    c = frame(spark, sf, "components")
    k = F.col("p_partkey")
    before = c.where(k % 10 != 0)
    after = c.where(k % 11 != 0).withColumns({
        "code_lines": F.col("code_lines") + F.when(k % 3 == 0, 5).when(k % 5 == 0, -3).otherwise(0),
        "category": F.when(k % 8 == 0, F.lit("verification")).otherwise(F.col("category")),
            "value_distance": F.when(k % 6 == 0, F.lit(None).cast("int")).otherwise(F.col("value_distance")),
    })
    return before, after


_BEFORE = "(select * from {components} where p_partkey % 10 <> 0)"
_AFTER = "(select * replace (code_lines + case when p_partkey % 3 = 0 then 5 when p_partkey % 5 = 0 then -3 else 0 end as code_lines, case when p_partkey % 8 = 0 then 'verification' else category end as category, case when p_partkey % 6 = 0 then null else value_distance end as value_distance) from {components} where p_partkey % 11 <> 0)"


def change_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """All files by how many of their lines moved."""
    before, after = _files(spark, sf)
    return compare.change_drivers(before, after, ("snapshot_id",), keep=None).select("path", "status", "before_category", "after_category",
        "before_code_lines", "after_code_lines", "movement", "delta")


def change_drivers_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The eight files that moved most of each snapshot."""
    before, after = _files(spark, sf)
    return compare.change_drivers(before, after, ("snapshot_id",)).select("rank", "path", "movement")


_DRIVERS = f"""
select path, case when b.path is null then 'added' when a.path is null then 'removed' when b.category <> a.category then 'recategorized' else 'changed' end status, b.category before_category, a.category after_category,
 coalesce(b.code_lines, 0) before_code_lines, coalesce(a.code_lines, 0) after_code_lines,
 case when b.category is not distinct from a.category then abs(coalesce(a.code_lines, 0) - coalesce(b.code_lines, 0)) else greatest(coalesce(b.code_lines, 0), coalesce(a.code_lines, 0)) end movement, coalesce(a.code_lines, 0) - coalesce(b.code_lines, 0) delta
from {_BEFORE} b full join {_AFTER} a using (path)"""


def layout_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Files by what changed in their layout."""
    before, after = (s.withColumn("weight", F.col("code_lines")) for s in _files(spark, sf))
    return compare.layout_changes(before, after, ("snapshot_id",)).select("path", *compare.FLAGS, "weight_delta")


def layout_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many files have each kind of change."""
    return compare.layout_summary(layout_delta(spark, sf).withColumn("snapshot_id", F.lit("parts")), ("snapshot_id",))


_LAYOUT = f"""
select * from (select path, b.path is null appeared, a.path is null disappeared, b.path is not null and a.path is not null and b.category is distinct from a.category classification_changed,
 coalesce(a.code_lines > b.code_lines, false) grew, coalesce(a.code_lines < b.code_lines, false) shrunk, b.path is not null and a.path is not null and b.value_distance is distinct from a.value_distance value_distance_changed,
 coalesce(a.code_lines, 0) - coalesce(b.code_lines, 0) weight_delta from {_BEFORE} b full join {_AFTER} a using (path)) where appeared or disappeared or classification_changed or grew or shrunk or value_distance_changed"""


def explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Gains and losses of each region in words."""
    return compare.explanations(category_delta(spark, sf), ("repository",))


def treemap_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangle of every folder and file."""
    return layout.treemap(frame(spark, sf, "components")).select("kind", "path", *[F.round(c, 3).alias(c) for c in ("x", "y", "width", "height")],
        "weight", "depth")


_TREE = """
with recursive f as (select path, code_lines w, string_split(path, '/') p from {components} where code_lines > 0),
 n as (select array_to_string(p[1:d], '/') path, d, sum(w)::bigint w, max((d = len(p))::int) = 1 leaf from (select *, unnest(range(1, len(p) + 1)) d from f) group by 1, 2),
 r as (select *, case when d = 1 then '' else regexp_replace(path, '/[^/]*$', '') end parent from n),
 o as (select *, coalesce(sum(w) over (partition by parent order by w desc, path rows between unbounded preceding and 1 preceding), 0)::bigint bw, sum(w) over (partition by parent)::bigint t,
  row_number() over (partition by parent order by w desc, path) = count(*) over (partition by parent) z from r),
 b(path, leaf, w, d, x, y, wd, ht) as (select '', false, 0::bigint, 0::bigint, 0.0::double, 0.0::double, 1000.0::double, 620.0::double
  union all select path, leaf, w, d, cx + pad, cy + pad, greatest(0.0::double, cw - 2 * pad), greatest(0.0::double, ch - 2 * pad) from (
   select *, case when leaf then 0.8::double else least(2.5::double, cw * 0.02::double, ch * 0.02::double) end pad from (
    select o.path, o.leaf, o.w, o.d, case when h then b.x + s * (bw / t) else b.x end cx, case when h then b.y else b.y + s * (bw / t) end cy,
     case when h then sz else b.wd end cw, case when h then b.ht else sz end ch from (
      select o.*, b.x, b.y, b.wd, b.ht, b.wd >= b.ht h, case when b.wd >= b.ht then b.wd else b.ht end s,
       greatest(0.0::double, case when z then (case when b.wd >= b.ht then b.wd else b.ht end) - (case when b.wd >= b.ht then b.wd else b.ht end) * (bw / t) else (case when b.wd >= b.ht then b.wd else b.ht end) * (o.w / t) end) sz
      from o join b on b.path = o.parent and not b.leaf and o.d = b.d + 1) o, (select 1) one_, lateral (select o.x, o.y, o.wd, o.ht) b)))
select case when leaf then 'file' else 'directory' end kind, path, round(round(x, 6), 3) x, round(round(y, 6), 3) y, round(round(wd, 6), 3) width, round(round(ht, 6), 3) height, w weight, d::int depth from b where path <> ''"""


def frame_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Files, lines and use of every day."""
    return metabolism.frame_metrics(frame(spark, sf, "use"))


def mass_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at the start, now, and the difference."""
    return metabolism.mass_delta(frame_metrics(spark, sf))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """First and last seen, last use and last change of every file."""
    return metabolism.usage(frame(spark, sf, "use"))


_USAGE = """
select repository, path, count(*) observed_frames, min(frame) first_seen, max(frame) last_seen, max(frame) filter (active) last_use, max(frame) filter (frame > 0 and not coalesce(print = lp and lf = frame - 1, false)) last_change
from (select *, lag(print) over w lp, lag(frame) over w lf from {use} window w as (partition by repository, path order by frame)) group by 1, 2"""


def status(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every file of the last day."""
    return metabolism.status(frame(spark, sf, "use"))


_STATUS = """
with u as (""" + _USAGE + """), e as (select repository, max(frame) m, count(distinct frame) n from {use} group by 1),
 now as (select x.*, n from {use} x join e using (repository) where frame = m), k as (select path, regexp_extract(path, '([0-9]{2,})', 1)::bigint v from now)
select repository, path, category, code_lines, case when active then 'active' when exists (select 1 from k a join k b on b.v > a.v where a.path = now.path) then 'superseded-candidate' when last_use is not null then 'dormant'
 when category in """ + _in(MACHINERY) + """ and observed_frames >= least(3, n) then 'bounded-orphan-candidate' else 'insufficient-evidence' end status, observed_frames, last_use, last_change
from now join u using (repository, path)"""


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many files and lines have each status."""
    return metabolism.status_counts(status(spark, sf))


def newer_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Newer members of version families: suppliers as releases of their nations, numbers repeated."""
    s = frame(spark, sf, "supplier").select(F.lit("r").alias("repository"),
        F.concat(F.lit("ops/n"), F.col("s_nationkey").cast("string"), F.lit("/release_"), F.lpad((F.col("s_suppkey") % 30).cast("string"), 2, "0"),
            F.lit("_"), F.chr(F.lit(97) + F.col("s_suppkey") % 3), F.lit(".SH")).alias("path")).distinct()
    return metabolism.newer_siblings(s).select("path", F.array_join("newer", ",").alias("newer"))


def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Different evidence of every user by kind of event and hour."""
    e = frame(spark, sf, "events").select(F.lit("e").alias("repository"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_type").alias("kind"), F.hour("ts").cast("string").alias("source"), F.lit("x").alias("detail"))
    return metabolism.evidence(e).select("path", F.array_join("kinds", ",").alias("kinds"),
        F.array_join(F.transform("evidence", lambda x: F.concat_ws("/", x["kind"], x["source"])), ";").alias("evidence"))


def content_hash_change(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of every text, and whether the one before it of its source and language has another."""
    from pyspark.sql import Window as W

    d = frame(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    by = W.partitionBy("source", "lang").orderBy("doc_id")
    return d.select("doc_id", "sha", (F.col("sha") != F.lag("sha").over(by)).alias("changed"))


def story_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the last comparison of the orders ends at the last scan."""
    o = frame(spark, sf, "orders").agg(F.max("o_orderdate").cast("date").cast("string").alias("sha"),
        F.min("o_orderdate").cast("date").cast("string").alias("before_sha"))
    line = frame(spark, sf, "lineitem").agg(F.max("l_shipdate").cast("date").cast("string").alias("after_sha"))
    return compare.story_coherence(o.select("sha"), o.select("before_sha").join(line, F.lit(True)))


def anatomy_by_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Line sums and shares of each region and year."""
    rows = frame(spark, sf, "frames").select(F.concat_ws("/", "repository", F.col("frame").cast("string")).alias("snapshot_id"), "category",
        "code_lines", F.lit(None).cast("int").alias("value_distance"))
    return metrics.composition(rows).select("snapshot_id", "total_lines", "product_lines", "machinery_lines", "tooling_share", "scaffolding_ratio")


QUERIES = {
    "category_delta": (category_delta, 'select repository, category, coalesce(b.n, 0)::bigint as "before", coalesce(a.n, 0)::bigint as "after", (coalesce(a.n, 0) - coalesce(b.n, 0))::bigint as "delta" from (select repository, category, sum(code_lines) n from {frames} where frame = 2 group by 1, 2) b full join (select repository, category, sum(code_lines) n from {frames} where frame = 3 group by 1, 2) a using (repository, category)'),
    "crossovers": (crossovers, f"with p as ({_PROFILES}) select b.repository, b.frame, b.path, a.product_lines before_product, a.machinery_lines before_machinery, b.product_lines after_product, b.machinery_lines after_machinery from p a join p b on a.repository = b.repository and a.path = b.path and b.frame = a.frame + 1 where a.product_lines > a.machinery_lines and b.machinery_lines > b.product_lines"),
    "inversion_diff": (inversion_diff, f"""with p as (select * from ({_PROFILES}) where product_lines > 0 and machinery_lines > product_lines), m as (select max(frame) m from ({_PROFILES}))
select b.repository, b.frame, b.path, 'added' as "change" from p b anti join (select repository, path, frame + 1 frame from p) a using (repository, path, frame) where frame > 0
union all select repository, frame + 1, path, 'removed' from p a where frame < (select m from m) and not exists (select 1 from p b where b.repository = a.repository and b.path = a.path and b.frame = a.frame + 1)"""),
    "history_checkpoints": (history_checkpoints, _CHECKS),
    "history_events": (history_events, _EVENTS),
    "change_drivers": (change_drivers, f"select * from ({_DRIVERS}) where movement > 0 or status <> 'changed'"),
    "change_drivers_topk": (change_drivers_topk, f'select row_number() over (order by movement desc, path)::int as "rank", path, movement from ({_DRIVERS}) where movement > 0 or status <> \'changed\' qualify row_number() over (order by movement desc, path) <= 8'),
    "layout_delta": (layout_delta, _LAYOUT),
    "layout_summary": (layout_summary, "select 'parts' snapshot_id, " + ", ".join(f"count(*) filter ({f}) {f}" for f in compare.FLAGS) + f" from ({_LAYOUT})"),
    "explanations": (explanations, """with d as (select repository, category, (coalesce(a.n, 0) - coalesce(b.n, 0))::bigint d from (select repository, category, sum(code_lines) n from {frames} where frame = 2 group by 1, 2) b full join (select repository, category, sum(code_lines) n from {frames} where frame = 3 group by 1, 2) a using (repository, category))
select repository, row_number() over (partition by repository order by abs(d) desc, category)::int as "rank", array_to_string(list_transform(string_split(category, '-'), lambda w: upper(w[1]) || w[2:]), ' ') || case when d > 0 then ' gained ' else ' lost ' end || format('{:,}', abs(d)) || ' LOC.' message from d where d <> 0"""),
    "treemap_layout": (treemap_layout, _TREE),
    "frame_metrics": (frame_metrics, f"select repository, frame, count(*) files, sum(code_lines)::bigint as lines, coalesce(sum(code_lines) filter (category in {_in(PRODUCT)}), 0)::bigint product_lines, coalesce(sum(code_lines) filter (category in {_in(MACHINERY)}), 0)::bigint machinery_lines, count(*) filter (active) active_files, coalesce(sum(code_lines) filter (active), 0)::bigint active_lines from {{use}} group by 1, 2"),
    "mass_delta": (mass_delta, 'with m as (select repository, frame, sum(code_lines)::bigint n from {use} group by 1, 2) select repository, arg_min(n, frame) as "start", arg_max(n, frame) as "current", arg_max(n, frame) - arg_min(n, frame) as "delta" from m group by 1'),
    "usage": (usage, _USAGE),
    "metabolism_status": (status, _STATUS),
    "metabolism_counts": (status_counts, f"select repository, status, count(*) files, sum(code_lines)::bigint as lines from ({_STATUS}) group by 1, 2"),
    "newer_siblings": (newer_siblings, """with s as (select distinct 'ops/n' || s_nationkey || '/release_' || lpad((s_suppkey % 30)::string, 2, '0') || '_' || chr((97 + s_suppkey % 3)::int) || '.SH' path, s_nationkey::string || chr((97 + s_suppkey % 3)::int) f, s_suppkey % 30 n from {supplier})
select a.path, string_agg(b.path, ',' order by b.n, b.path) newer from s a join s b on a.f = b.f and b.n > a.n group by 1"""),
    "evidence_dedup": (evidence_dedup, """with e as (select distinct 'u' || user_id path, event_type k, hour(ts)::string h from {events}) select path, (select string_agg(k, ',' order by k) from (select distinct k from e x where x.path = e.path)) kinds, string_agg(k || '/' || h, ';' order by k, h) evidence from e group by path"""),
    "content_hash_change": (content_hash_change, 'select doc_id, sha256(coalesce(text, \'\')) sha, sha256(coalesce(text, \'\')) <> lag(sha256(coalesce(text, \'\'))) over (partition by source, lang order by doc_id) as "changed" from {documents}'),
    "story_coherence": (story_coherence, "with o as (select max(o_orderdate)::date::string scan_sha, min(o_orderdate)::date::string before_sha from {orders}), l as (select max(l_shipdate)::date::string after_sha from {lineitem}) select *, scan_sha = after_sha as matches, case when scan_sha <> after_sha then 'comparison ends at ' || after_sha || ', scan is of ' || scan_sha end warning from o, l"),
    "anatomy_by_frame": (anatomy_by_frame, f"select *, machinery_lines / total_lines tooling_share, case when product_lines > 0 then machinery_lines / product_lines when machinery_lines > 0 then null else 0.0::double end scaffolding_ratio from (select repository || '/' || frame snapshot_id, coalesce(sum(code_lines) filter (category <> 'documentation'), 0)::bigint total_lines, coalesce(sum(code_lines) filter (category in {_in(PRODUCT)}), 0)::bigint product_lines, coalesce(sum(code_lines) filter (category in {_in(MACHINERY)}), 0)::bigint machinery_lines from {{frames}} group by 1)"),
}
