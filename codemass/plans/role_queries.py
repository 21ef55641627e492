"""Queries of symbol roles, import relationships and declared surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.operators import classify, resolve, surfaces
from codemass.plans.proxies import frame
from codemass.schema import MACHINERY, PRODUCT

_PATHS = ("src/shop/a.py", "lib/b.py", "tests/c.py", "audits/d.py", "app/validators/e.py", "x/y/f.py", "src/g.py", "ops/ci/h.py")
_NAMES = ("verifyOrder", "open_menu", "auditQuality", "parse_config", "images", "TraceLogger", "run", "release_notes", "cacheStore", "validator")
_LINES = ("return menu.route(command)", "audit audit provenance ledger", "x = 1", "verify checksum sha256; integrity",
    "config = load(storage, cache)", "logger.monitor(trace)")


def _of(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def symbol_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The refined role of every symbol, by its path, its own words and its body."""
    n = F.substring("id", 2, 20).cast("long")
    s = frame(spark, sf, "symbols").withColumns({
        "path": _of(_PATHS, n), "name": _of(_NAMES, F.floor(n / 8)), "qualified_name": F.concat(F.lit("m."), _of(_NAMES, F.floor(n / 80))),
        "start_line": (n % 6 + 1).cast("int"), "end_line": (n % 6 + 1 + n % 2).cast("int"),
    })
    files = spark.range(len(_PATHS)).select(F.lit("parts").alias("snapshot_id"), _of(_PATHS, F.col("id")).alias("path"),
        F.array(*map(F.lit, _LINES)).alias("lines_of"))
    return classify.refine_symbols(s, files).select("id", "category", F.round("role_confidence", 9).alias("role_confidence"), "role_source")


def _gram_sql(value: str) -> str:
    parts = f"string_split_regex(trim(regexp_replace(lower(regexp_replace({value}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"(select p || list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]) || list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2]) from (select {parts} p))"


def _roles_sql() -> str:
    """The same rules written out as SQL."""
    listed = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
    inside = lambda g: "(" + ", ".join(f"'{x}'" for x in g) + ")"
    role = "case " + " ".join(f"when list_has_any(pt, {listed(w)}) then '{c}'" for c, w in classify.PATH_ROLES.items()) + " end"
    scores = []
    for k, (c, words) in enumerate(classify.ROLE_WORDS.items()):
        a, b = f"len(list_intersect(nt, {listed(words)}))", f"len(list_intersect(bt, {listed(words)}))"
        meta = "+ 1.0::double" if c == "meta-machinery" else ""
        scores.append(f"{{'c': '{c}', 'k': {k}, 's': case when {a} > 0 or {b} > 0 then (case when {a} > 0 then 5.0::double + least(2.0::double, 0.5::double * ({a} - 1)) {meta} else 0.0::double end) + case when {b} > 0 then least(2.0::double, 0.35::double * {b}) else 0.0::double end end}}")
    return f"""
with s as (select id, kind, category, substring(id, 2)::bigint n from {{symbols}}),
 p as (select *, {listed(_PATHS)}[n % {len(_PATHS)} + 1] path, {listed(_NAMES)}[(n // 8) % {len(_NAMES)} + 1] a, 'm.' || {listed(_NAMES)}[(n // 80) % {len(_NAMES)} + 1] q, array_to_string({listed(_LINES)}[n % 6 + 1:least(6, n % 6 + 1 + n % 2)], chr(10)) body from s),
 t as (select *, {_gram_sql("path")} pt, {_gram_sql("regexp_replace(path, '/[^/]*$', '')")} ft, {_gram_sql("a")} || {_gram_sql("q")} nt, {_gram_sql("body")} bt from p),
 r as (select *, {role} pr, list_has_any(ft, {listed(classify.PRODUCT_FOLDERS)}) fo, [{", ".join(scores)}] sc from t),
 x as (select id, e.c, e.s, row_number() over (partition by id order by e.s desc, e.k) k from (select id, unnest(sc) e from r) where e.s is not null),
 b as (select id, max(c) filter (k = 1) c, max(s) filter (k = 1) s, coalesce(max(s) filter (k = 2), 0.0::double) s2 from x group by id),
 j as (select r.*, b.c, b.s, coalesce(b.s >= 5.0 and b.s - b.s2 >= 0.5, false) clear, r.category in {inside(MACHINERY)} mach, coalesce(b.c in {inside(MACHINERY)}, false) bm from r left join b using (id))
select id, case when kind = 'file' then category when pr is not null then pr when not mach and clear and not bm then c when not mach then category when clear and bm then c when fo then 'core-product' else 'essential-support' end category,
 round(case when kind = 'file' then 1.0::double when pr is not null then 0.98::double when not mach and clear and not bm then least(0.95::double, 0.66::double + 0.04::double * s) when not mach then case when category in {inside(PRODUCT)} then 0.72::double else 0.62::double end
  when clear and bm then least(0.97::double, 0.68::double + 0.04::double * s) when fo then 0.68::double else 0.62::double end, 9) role_confidence,
 case when kind = 'file' then 'file-classification' when pr is not null then 'strong-path-role' when not mach and clear and not bm then 'symbol-local-product-evidence' when not mach then 'file-seed-preserved'
  when clear and bm then 'symbol-local-machinery-evidence' else 'mixed-file-context-fallback' end role_source from j"""


def import_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Import statements of every component resolved through the dependencies of its file."""
    rows = frame(spark, sf, "imports")
    files = rows.select("snapshot_id", F.concat("path", F.lit("::<file>")).alias("id"), "path", F.lit("file").alias("kind"))
    deps = resolve.file_dependencies(rows.select("snapshot_id", "path", F.array("raw").alias("imports")))
    edges = rows.select(
        "snapshot_id", F.col("p_partkey").alias("edge_seq"), F.concat("path", F.lit("::<file>")).alias("source_id"), F.lit("imports").alias("kind"),
        F.lit(None).cast("string").alias("target_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("import "), F.col("raw"))).otherwise(
            F.concat(F.lit("from \""), F.replace("raw", F.lit("."), F.lit("/")), F.lit('";'))).alias("target_name"),
    )
    return resolve.resolve_imports(edges, files, deps).select("edge_seq", "target_id", "resolution")


def public_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Public declarations and user-surface symbols without a parent."""
    s = frame(spark, sf, "symbols").withColumns({"role_confidence": F.lit(0.9), "role_source": F.lit("x"), "name": F.initcap("name"), "start_line": F.lit(1)})
    files = s.select("snapshot_id", "path").distinct().withColumn("text", F.lit("first line"))
    none = s.where("end_line % 2 = 0").select("snapshot_id", F.col("id").alias("symbol_id"))
    return surfaces.declared_surfaces(files, s, none).select("kind", "name", "path", "symbol_id", "detail")


QUERIES = {
    "symbol_roles": (symbol_roles, _roles_sql()),
    "import_relationships": (import_relationships, """
with i as (select path, p_partkey, split_part(raw, '.', 1) m, split_part(raw, '.', 2) t from {imports}), f as (select path, split_part(split_part(path, '/', 3), '.', 1) stem, split_part(path, '/', 2) b from i)
select i.p_partkey edge_seq, f.path || '::<file>' target_id, 'exact' resolution from i join f on f.stem = i.t and f.b = i.m where f.path <> i.path"""),
    "public_surfaces": (public_surfaces, """
select case when language = 'go' then 'public-symbol' else 'user-surface' end kind, qualified_name as name, path, id symbol_id, case when language = 'go' then 'Go exported identifier ' || upper(name[1]) || name[2:] else 'x; confidence=0.90' end detail
from {symbols} where parent_id is null and kind not in ('file') and end_line % 2 = 1 and (language = 'go' or category = 'user-surface')"""),
}
