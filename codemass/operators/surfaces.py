"""Externally visible surfaces, their anchors, and journeys of data types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.functions.scalars import member_role
from codemass.functions.spread import spread
from codemass.functions.text import file_name, lines_of, strip
from codemass.operators import traverse
from codemass.schema import JOURNEY_ROLES

SNAP = "snapshot_id"

# How the frameworks declare routes and entry points, by language.
PY_ROUTE = r"""^\s*@[\w.]+\.(get|post|put|patch|delete|options|head)\(\s*[rubfRUBF]*["']([^"']+)"""
PY_ANY_ROUTE = r"""^\s*@[\w.]+\.route\(\s*[rubfRUBF]*["']([^"']+)"""
JS_ROUTE = r"""\b(?:app|router|server)\.(get|post|put|patch|delete|options|head)\(\s*["']([^"']+)"""
CSHARP_ROUTE = r"""^\s*\[Http(Get|Post|Put|Patch|Delete|Head|Options)(?:\(\s*["']([^"']*)["'])?"""
JAVA_ROUTE = r"""^\s*@(Get|Post|Put|Patch|Delete|Request)Mapping(?:\(\s*(?:value\s*=\s*)?["']([^"']*)["'])?"""
RUST_ROUTE = r'^\s*#\[(get|post|put|patch|delete|head|options)\(\s*"([^"]+)"'
JS_EXPORT = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][\w$]*)"
SCRIPT = r"""^\s*["']?([A-Za-z0-9_.-]+)["']?\s*=\s*["']([^"']+)["']\s*$"""
SCRIPT_SECTIONS = ("project.scripts", "project.gui-scripts", "tool.poetry.scripts")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, language, line, raw): a row for each line, from 1."""
    return files.select(SNAP, "path", "language", F.posexplode(lines_of("text")).alias("_p", "raw")).select(SNAP, "path", "language",
        (F.col("_p") + 1).alias("line"), "raw")


def routes(files: DataFrame) -> DataFrame:
    """(snapshot_id, kind, name, path, line, evidence_kind, detail): routes that lines declare, one a line."""
    raw, lang = F.col("raw"), F.col("language")
    part = lambda p, k: F.regexp_extract(raw, p, k)
    script = lang.isin("javascript", "typescript", "tsx")
    plain = lambda p: F.concat_ws(" ", F.upper(part(p, 1)), part(p, 2))
    named = lambda p, none: F.concat_ws(" ", F.upper(part(p, 1)), F.when(part(p, 2) == "", none).otherwise(part(p, 2)))
    rules = [
        ((lang == "python") & raw.rlike(PY_ROUTE), plain(PY_ROUTE), "route-declaration"),
        ((lang == "python") & raw.rlike(PY_ANY_ROUTE), F.concat(F.lit("ROUTE "), part(PY_ANY_ROUTE, 1)), "route-declaration"),
        (script & raw.rlike(JS_ROUTE), plain(JS_ROUTE), "route-declaration"),
        ((lang == "csharp") & raw.rlike(CSHARP_ROUTE), named(CSHARP_ROUTE, "<attribute-route>"), "route-attribute"),
        (lang.isin("java", "kotlin") & raw.rlike(JAVA_ROUTE), named(JAVA_ROUTE, "<annotation-route>"), "route-annotation"),
        ((lang == "rust") & raw.rlike(RUST_ROUTE), plain(RUST_ROUTE), "route-attribute"),
    ]
    found = F.lit(None).cast("struct<name:string,evidence:string>")
    for test, name, how in reversed(rules):
        found = F.when(test, F.struct(name.alias("name"), F.lit(how).alias("evidence"))).otherwise(found)
    rows = numbered_lines(files).withColumn("_f", found).where("_f is not null")
    return rows.select(SNAP, F.lit("http-route").alias("kind"), F.col("_f.name").alias("name"), "path", "line",
        F.col("_f.evidence").alias("evidence_kind"), strip(raw).alias("detail"))


def packaged_scripts(files: DataFrame) -> DataFrame:
    """Entry points that pyproject.toml names: kind cli, and module and callable to anchor them by."""
    rows = numbered_lines(files.where(file_name("path") == "pyproject.toml"))
    s = strip(F.col("raw"))
    header = s.startswith("[") & s.endswith("]")
    section = F.last(F.when(header, F.trim(F.expr("substring(trim(raw), 2, length(trim(raw)) - 2)"))),
        ignorenulls=True).over(W.partitionBy(SNAP, "path").orderBy("line"))
    hit = rows.withColumns({"_s": section, "_h": header, "_t": F.regexp_extract("raw", SCRIPT, 2)}).where(
        ~F.col("_h") & F.col("_s").isin(*SCRIPT_SECTIONS) & F.col("_t").contains(":"))
    return hit.select(
        SNAP, F.lit("cli").alias("kind"), F.regexp_extract("raw", SCRIPT, 1).alias("name"), "path", "line",
        F.lit("packaging-entrypoint").alias("evidence_kind"),
        F.concat(F.lit("["), F.col("_s"), F.lit("] -> "), F.col("_t")).alias("detail"), F.trim(F.substring_index("_t", ":", 1)).alias("module"),
        F.trim(F.substring_index(F.substring_index(F.substring_index("_t", ":", -1), ":", 1), ".", 1)).alias("callable"),
    )


def package_bins(files: DataFrame) -> DataFrame:
    """Entry points that package.json names under bin, a text or a map."""
    rows = files.where(file_name("path") == "package.json").select(SNAP, "path", "text")
    one = F.get_json_object("text", "$.bin")
    many = F.from_json(one, "map<string,string>")
    folder = F.element_at(F.split(F.concat(F.lit("/package/"), F.regexp_replace("path", "/?[^/]*$", "")), "/"), -1)
    own = F.coalesce(F.get_json_object("text", "$.name"), F.when(folder == "", "package").otherwise(folder))
    bins = F.when(one.startswith("{"), many).otherwise(F.when(one.isNotNull(), F.create_map(own, one)))
    return rows.select(SNAP, "path", F.explode(bins).alias("name", "target")).select(
        SNAP, F.lit("cli").alias("kind"), "name", "path", F.lit(1).alias("line"), F.lit("package-entrypoint").alias("evidence_kind"),
        F.concat(F.lit("package.json bin -> "), F.col("target")).alias("detail")
    )


def exports(files: DataFrame) -> DataFrame:
    """Names that script files export."""
    rows = numbered_lines(files.where(F.col("language").isin("javascript", "typescript", "tsx"))).where(F.col("raw").rlike(JS_EXPORT))
    return rows.select(SNAP, F.lit("public-api").alias("kind"), F.regexp_extract("raw", JS_EXPORT, 1).alias("name"), "path", "line",
        F.lit("explicit-export").alias("evidence_kind"), strip(F.col("raw")).alias("detail"))


def nearest_symbol(places: DataFrame, symbols: DataFrame, *, after_lines: int = 8) -> DataFrame:
    """``places`` (snapshot_id, path, line, name nullable) with symbol_id: the nearest symbol of the file, null if none.

    First one of the name, nearest by line; else the smallest that holds the line; else the next that starts within
    ``after_lines``.  Files, modules and namespaces are no anchors.  Each rule is an equi-join of its own: names by equality;
    spans by blocks of lines as wide as the span's size class, so that a span lies in two blocks at most; starts by blocks of
    ``after_lines`` + 1 lines.
    """
    keys, at = [SNAP, "path", "line", "name"], [SNAP, "path"]
    asked = places.select(*keys).distinct()
    width = F.col("end_line") - F.col("start_line")
    inner = symbols.where("kind not in ('file', 'module', 'namespace')").select(
        *at, "name", F.col("qualified_name").alias("_q"), F.col("start_line").alias("_a"), width.alias("_w"), F.col("id").alias("_id")
    )
    # the first of each place is found in parts, a task each, before the parts meet
    inner = spread(inner)
    one = F.min(F.struct("_w", "_q", "_id")).alias("_s")
    line, start, size = F.col("line"), F.col("_a"), F.col("_s._w")

    called = inner.select(*at, F.explode(F.array_distinct(F.array("name", "_q"))).alias("name"), "_a", "_w", "_q", "_id")
    named = asked.join(called.groupBy(*at, "name", "_a").agg(one), [*at, "name"]).select(*keys, F.lit(0).alias("_t"), F.abs(start - line).alias("_x"),
        "_a", "_s")

    spans = inner.where("_w >= 0").groupBy(*at, "_a", "_w").agg(one).withColumn("_class", F.length(F.bin("_w")))
    block = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_class")))
    spans = spans.withColumn("_block", F.explode(F.sequence(block(start), block(start + F.col("_w"))))).drop("_w")
    within = asked.join(spans.select(*at, "_class").distinct(), at).withColumn("_block", block(line))
    held = within.join(spans, [*at, "_class", "_block"]).where((start <= line) & (line <= start + size)).select(*keys, F.lit(1).alias("_t"),
        size.alias("_x"), "_a", "_s")

    reach = after_lines + 1
    starts = inner.groupBy(*at, "_a").agg(one).withColumn("_block", F.floor(start / reach))
    soon = asked.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(line / reach), F.floor((line + after_lines) / reach)))))
    next_one = soon.join(starts, [*at, "_block"]).where((line <= start) & (start <= line + after_lines)).select(*keys, F.lit(2).alias("_t"),
        start.alias("_x"), "_a", "_s")

    found = named.unionByName(held).unionByName(next_one)
    best = found.groupBy(*keys).agg(F.min(F.struct("_t", "_x", "_a", "_s")).alias("_m")).select(*keys, F.col("_m._s._id").alias("symbol_id"))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return places.alias("p").join(best.alias("b"), on[0] & on[1] & on[2] & on[3], "left").select("p.*", "b.symbol_id")


def module_symbol(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """``wanted`` (snapshot_id, module, callable, ...) with symbol_id: the one symbol of a file whose path ends so.

    If several fit, the only one without a parent; else null.  An ending need not start at a slash.  Paths are cut to each
    length that a module asked for with the callable has; these endings join by equality.
    """
    on = [SNAP, "callable", "_end"]
    last = F.element_at(F.split("qualified_name", r"\."), -1)
    both_names = F.array("name", F.when(F.col("qualified_name").contains("."), last).otherwise(F.col("name")))
    named = spread(symbols.where(F.col("path").endswith(".py"))).select(SNAP, "id", "path", "parent_id", F.explode(F.array_distinct(both_names)).alias("callable"))
    asked = wanted.select(SNAP, "module", "callable").distinct().withColumn("_end", F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")))
    sizes = asked.select(SNAP, "callable", F.length("_end").alias("_size")).distinct()
    cut = named.join(sizes, [SNAP, "callable"]).where(F.col("_size") <= F.length("path")).withColumn("_end", F.right("path", F.col("_size")))
    top = F.when(F.col("parent_id").isNull(), F.col("id"))
    # one symbol is all there is where the least is the greatest
    counted = cut.groupBy(*on).agg(F.min("id").alias("_id"), F.max("id").alias("_last"), F.min(top).alias("_top"), F.max(top).alias("_last_top"))
    answer = F.when(F.col("_id") == F.col("_last"), F.col("_id")).when(F.col("_top") == F.col("_last_top"), F.col("_top"))
    picked = asked.join(counted, on).select(SNAP, "module", "callable", answer.alias("symbol_id"))
    return wanted.join(picked, [SNAP, "module", "callable"], "left")


# How entry points and public declarations read.
MAINS = {"go": ("main", r"\bfunc\s+main\s*\("), "java": ("main", r"(?i)\bstatic\s+void\s+main\s*\("), "csharp": ("Main", r"\bstatic\b.*\bMain\s*\(")}
PUBLIC, RUST_PUBLIC = r"^\s*public\b", r"^\s*pub(?:\([^)]*\))?\s+"


def _stem(path: str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def entry_points(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules with a main guard, and the main functions of compiled languages whose line declares one.

    (snapshot_id, kind, name, path, line, evidence_kind, detail, symbol_id): the first main of a file.
    """
    wanted = F.when(F.col("language") == "python", "main")
    for language, (name, _) in MAINS.items():
        wanted = F.when(F.col("language") == language, name).otherwise(wanted)
    asked = files.withColumn("_main", wanted).where("_main is not null")
    inner = symbols.where("kind not in ('file', 'module', 'namespace')").select(SNAP, "path", F.col("name").alias("_n"),
        F.col("qualified_name").alias("_q"), "id", "start_line")
    hit = asked.join(inner, [SNAP, "path"]).where("_n = _main or _q = _main")
    first = hit.groupBy(SNAP, "path", "language", "_main").agg(F.min_by(F.struct("id", "start_line", "_n"), F.struct("start_line", "id")).alias("m"))
    rows = first.join(files.select(SNAP, "path", "text"), [SNAP, "path"])
    line = F.coalesce(F.try_element_at(lines_of("text"), F.col("m.start_line")), F.lit(""))
    fits = (F.col("language") == "python") & F.col("text").contains("__name__") & F.col("text").contains("__main__")
    for language, (_, pattern) in MAINS.items():
        fits = fits | ((F.col("language") == language) & line.rlike(pattern))
    python = F.col("language") == "python"
    return rows.where(fits).select(
        SNAP, F.lit("entrypoint").alias("kind"), F.when(python, _stem("path")).otherwise(F.concat_ws(".", _stem("path"), "m._n")).alias("name"),
        "path", F.col("m.start_line").alias("line"),
        F.concat("language", F.lit("-main")).alias("evidence_kind"),
        F.when(python, "module contains an __main__ guard anchored to main()").otherwise(strip(line)).alias("detail"), F.col("m.id").alias("symbol_id"),
    )


def declared_surfaces(files: DataFrame, symbols: DataFrame, anchored: DataFrame, *, top_level: str = "no_parent") -> DataFrame:
    """Public declarations and user-surface symbols that no other surface anchors yet.

    ``anchored``: snapshot_id, symbol_id.  ``top_level``: "no_parent" takes symbols without any parent only;
    "file_parent" also those whose parent is their file, as the parser makes them.
    """
    top = F.col("parent_id").isNull()
    if top_level == "file_parent":
        top = top | (F.col("parent_id") == F.concat("path", F.lit("::<file>")))
    rows = symbols.where(top & ~F.col("name").startswith("_") & ~F.col("kind").isin("file", "module", "namespace", "variable", "unknown"))
    rows = rows.join(anchored.select(SNAP, F.col("symbol_id").alias("id")).distinct(), [SNAP, "id"],
        "left_anti").join(files.select(SNAP, "path", "text"), [SNAP, "path"], "left")
    line = strip(F.coalesce(F.try_element_at(lines_of(F.coalesce("text", F.lit(""))), F.greatest(F.col("start_line"), F.lit(1))), F.lit("")))
    lang = F.col("language")
    public = (lang.isin("csharp", "java", "kotlin") & line.rlike(PUBLIC)) | ((lang == "rust") & line.rlike(RUST_PUBLIC)) | (
        (lang == "go") & F.col("name").rlike(r"^\p{Lu}"))
    surface = (F.col("category") == "user-surface") & (F.col("role_confidence") >= 0.80)
    kind = F.when(public, "public-symbol").when(surface, "user-surface")
    detail = F.when(public & (lang == "go"), F.concat(F.lit("Go exported identifier "), F.col("name"))).when(public,
        line).otherwise(F.format_string("%s; confidence=%.2f", F.col("role_source"), F.col("role_confidence")))
    return rows.withColumn("_kind", kind).where("_kind is not null").select(
        SNAP, F.col("_kind").alias("kind"), F.col("qualified_name").alias("name"), "path", F.col("start_line").alias("line"),
        F.when(public, "language-public-declaration").otherwise("semantic-role").alias("evidence_kind"), detail.alias("detail"), F.col("id").alias("symbol_id"),
    )


def journey_warnings(events: DataFrame, types: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, warning): stages without events, members with a role that nothing calls, calls that are not exact."""
    stages = journey_stages(events, types).where("events = 0")
    missing = stages.groupBy(SNAP, "type_id").agg(
        F.concat(F.lit("No canonical lifecycle event was observed for: "), F.array_join(F.array_sort(F.collect_list("role")), ", ")).alias("warning"))
    ends = members(symbols, edges).join(types, [SNAP, "type_id"])
    called = events.select(SNAP, "type_id", F.col("target_id").alias("id")).distinct()
    idle = ends.where("role is not null").join(called, [SNAP, "type_id", "id"], "left_anti").groupBy(SNAP,
        "type_id").agg(F.concat(F.count("*").cast("string"), F.lit(" lifecycle-shaped member definition(s) have no observed exact caller.")).alias("warning"))
    near = ends.select(SNAP, "type_id", F.col("id").alias("target_id")).union(types.select(SNAP, "type_id", F.col("type_id").alias("target_id")))
    loose = edges.where("kind = 'calls' and resolution <> 'exact'").join(near, [SNAP, "target_id"]).select(SNAP, "type_id",
        F.lit("Probable or unresolved calls touch this data neighborhood.").alias("warning")).distinct()
    return missing.union(idle).union(loose)


def merge_capabilities(found: DataFrame, *, keep: int = 200) -> DataFrame:
    """One row for each (kind, name, path, line): evidence joined in order, the first anchor; the first 200 of a snapshot.

    ``found``: snapshot_id, kind, name, path, line, symbol_id, evidence_kind, detail, seq.
    """
    listed = F.array_sort(F.collect_list(F.struct("seq", "evidence_kind", "detail")))
    rows = found.groupBy(SNAP, "kind", "name", "path", "line").agg(
        F.transform(listed, lambda e: F.struct(e["evidence_kind"].alias("kind"), e["detail"].alias("detail"))).alias("evidence"),
        F.min_by("symbol_id", F.when(F.col("symbol_id").isNotNull(), F.col("seq"))).alias("symbol_id"),
    )
    order = W.partitionBy(SNAP).orderBy("kind", F.lower("name"), "path", "line", "name")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def implementation(capabilities: DataFrame, symbols: DataFrame, edges: DataFrame, *, max_depth: int = 4, max_symbols: int | None = 250) -> DataFrame:
    """(snapshot_id, anchor, id, path, hops, truncated): symbols that each anchored capability reaches over exact edges, containment too.

    Capabilities of one anchor share its rows.  The nearest symbols come first where there are more than ``max_symbols``.
    """
    anchors = capabilities.where("symbol_id is not null").select(SNAP, F.col("symbol_id").alias("node")).distinct()
    own = symbols.select(SNAP, "id", "path")
    anchors = anchors.join(own.select(SNAP, F.col("id").alias("node")), [SNAP, "node"], "left_semi")
    found = traverse.neighbourhood(traverse.exact_edges(edges, contains=True), anchors, max_depth=max_depth, max_symbols=max_symbols)
    return found.withColumnRenamed("node", "id").join(own, [SNAP, "id"]).select(SNAP, "anchor", "id", "path", "hops", "truncated")


def with_implementation(capabilities: DataFrame, reached: DataFrame, edges: DataFrame) -> DataFrame:
    """``capabilities`` with implementation_files, implementation_symbols, truncated, and counts of edges that are not exact.

    ``reached``: as ``implementation`` gives it.  A capability without an anchor has empty lists and no edges.
    """
    of = reached.groupBy(SNAP, "anchor").agg(
        F.array_sort(F.collect_set("path")).alias("implementation_files"), F.array_sort(F.collect_list("id")).alias("implementation_symbols"),
        F.max("truncated").alias("truncated")
    )
    loose = edges.where("resolution <> 'exact'").groupBy(SNAP, F.col("source_id").alias("id")).agg(
        F.sum((F.col("resolution") == "probable").cast("long")).alias("_p"), F.sum((F.col("resolution") == "unresolved").cast("long")).alias("_u")
    )
    counts = reached.select(SNAP, "anchor", "id").join(loose, [SNAP, "id"]).groupBy(SNAP, "anchor").agg(F.sum("_p").alias("probable_relationships"),
        F.sum("_u").alias("unresolved_relationships"))
    rows = capabilities.withColumnRenamed("symbol_id", "anchor").join(of.join(counts, [SNAP, "anchor"], "left"), [SNAP, "anchor"],
        "left").withColumnRenamed("anchor", "symbol_id")
    nothing = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, nothing) for c in ("implementation_files", "implementation_symbols")})
    return rows.fillna(0, ["probable_relationships", "unresolved_relationships"]).fillna(False, ["truncated"])


def atlas_counts(capabilities: DataFrame) -> DataFrame:
    """(snapshot_id, anchored, unanchored)."""
    return capabilities.groupBy(SNAP).agg(F.count("symbol_id").alias("anchored"), F.sum(F.col("symbol_id").isNull().cast("long")).alias("unanchored"))


def members(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, id, name, kind, role): members of each type by exact containment; role null if none."""
    inside = edges.where("kind = 'contains' and resolution = 'exact'").select(SNAP, F.col("source_id").alias("type_id"),
        F.col("target_id").alias("id")).distinct()
    own = symbols.where("kind <> 'file'").select(SNAP, "id", "name", "kind")
    return inside.join(own, [SNAP, "id"]).withColumn("role", member_role("kind", "name"))


def journeys(types: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, role, source_id, target_id, evidence): exact calls to a type or to its members with a role.

    ``types``: snapshot_id, type_id.  Of repeated (role, source, target) the first edge holds.
    """
    ends = members(symbols, edges).where("role is not null").join(types, [SNAP, "type_id"]).select(SNAP, "type_id", F.col("id").alias("target_id"), "role")
    own = types.select(SNAP, "type_id", F.col("type_id").alias("target_id"), F.lit("created").alias("role"))
    calls = edges.where("kind = 'calls' and resolution = 'exact'").select(SNAP, "source_id", "target_id", "edge_seq", "evidence")
    hit = calls.join(ends.unionByName(own), [SNAP, "target_id"])
    return hit.groupBy(SNAP, "type_id", "role", "source_id", "target_id").agg(F.min_by("evidence", "edge_seq").alias("evidence"))


def journey_stages(events: DataFrame, types: DataFrame) -> DataFrame:
    """(snapshot_id, type_id, role, events): all four stages of each type, 0 where nothing happens."""
    every = types.select(SNAP, "type_id", F.explode(F.array(*map(F.lit, JOURNEY_ROLES))).alias("role"))
    counts = events.groupBy(SNAP, "type_id", "role").agg(F.count("*").alias("events"))
    return every.join(counts, [SNAP, "type_id", "role"], "left").fillna(0, ["events"])
