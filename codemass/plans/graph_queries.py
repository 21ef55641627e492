"""Queries of traversals, resolution and surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.functions.spread import apart, spread
from codemass.operators import compare, journeys, metabolism, metrics, references, resolve, searches, surfaces, traverse
from codemass.plans import explore, measure_queries
from codemass.plans.proxies import frame
from codemass.schema import AUDIT, BASE_DISTANCE, MACHINERY, PRODUCT, RECURSIVE


def _in(group: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in group) + ")"


_BASE = "case category " + " ".join(f"when '{k}' then {v}" for k, v in BASE_DISTANCE.items()) + " end"


def value_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Every component's distance from product code."""
    return traverse.value_distances(frame(spark, sf, "components"), frame(spark, sf, "edges")).select("path", "category", "value_distance")


_HOPS = """
with recursive e as (select a, b from {pairs} where a <> b union select b, a from {pairs} where a <> b),
 w(node, h) as (select p_partkey, 0 from {components} where category in ('core-product', 'user-surface') union select e.b, h + 1 from w join e on e.a = w.node where h < 24),
 d as (select node, min(h) h from w group by node)"""


def audit_chain_depth(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest chain of machinery upon machinery over each product component."""
    chains, names, _ = traverse.audit_chain_codes(frame(spark, sf, "components"), frame(spark, sf, "edges"))
    deep = chains.groupBy(F.col("codes")[0].alias("code")).agg(F.max("depth").alias("max_depth"))
    return deep.join(names, "code").select(F.col("id").alias("root"), "max_depth")


def _levels(first: str, grow: str, depth: int) -> str:
    """A traversal in SQL, a level after another: l0, l1, ... as ``first`` and ``grow`` of the level before."""
    return ",\n".join([f" l0 as ({first})", *(f" l{i} as ({grow.format(f'l{i - 1}')})" for i in range(1, depth + 1))])


_WALKS = f"""
with e as (select distinct src, dst from {{edges}}), k as (select path, category, code_lines from {{components}}),
""" + _levels(
    f"select path root, path node, [path] paths from k where category in {_in(PRODUCT)}",
    "select root, e.src node, list_append(paths, e.src) paths from (select root, node, min(paths) paths from {} group by root, node) m join e on e.dst = m.node "
    f"join k on k.path = e.src and k.category in {_in(RECURSIVE)} where not list_contains(paths, e.src)",
    8,
) + ", c as (" + " union all ".join(f"select root, paths, {i} depth from l{i}" for i in range(1, 9)) + ")"


def audit_chain_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 deepest chains that begin no longer one."""
    chains, names, _ = traverse.audit_chain_codes(frame(spark, sf, "components"), frame(spark, sf, "edges"))
    return traverse.top_chain_codes(chains, names).select("rank", "depth", "total_lines", F.array_join("paths", " > ").alias("chain"))


def audit_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a budget of three expansions is reported as truncation."""
    _, spent = traverse.audit_chains(frame(spark, sf, "components"), frame(spark, sf, "edges"), budget=3)
    return spent


def symbol_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Every symbol's distance from product symbols over exact links, null where there is none."""
    return traverse.symbol_distances(frame(spark, sf, "symbols"), frame(spark, sf, "links")).select("id", "kind", "category", "value_distance")


_EXACT = "(select source_id a, target_id b, kind, edge_seq from {links} where resolution = 'exact' and target_id is not null)"
_NEAR = f"""
with recursive e as (select a, b from {_EXACT} union select b, a from {_EXACT}),
 w(node, h) as (select id, 0 from {{symbols}} where category in {_in(PRODUCT)} and kind <> 'file' union select e.b, h + 1 from w join e on e.a = w.node where h < 24),
 d as (select node, min(h) h from w group by node)"""


def recursive_chain_depth(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest recursive chain over each product symbol."""
    return traverse.recursive_depths(frame(spark, sf, "symbols"), frame(spark, sf, "links"))


_CALLERS = f"""
with k as (select id, category, kind from {{symbols}}), e as (select a, b, edge_seq from {_EXACT} where kind <> 'contains'),
""" + _levels(
    f"select id root, id node, [id] ids, []::bigint[] seqs, false emit from k where category in {_in(PRODUCT)} and kind <> 'file'",
    "select root, e.a node, list_append(ids, e.a) ids, list_append(seqs, edge_seq) seqs, "
    f"k.category in {_in(RECURSIVE)} emit from (select root, node, arg_min(ids, seqs) ids, min(seqs) seqs from {{}} group by root, node) m "
    f"join e on e.b = m.node join k on k.id = e.a and k.category in {_in(MACHINERY)} where not list_contains(ids, e.a)",
    12,
) + ", c as (" + " union ".join(f"select root, ids from l{i} where emit" for i in range(1, 13)) + ")"


def value_path_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest call path of every constructor."""
    s = frame(spark, sf, "symbols")
    calls = traverse.exact_edges(frame(spark, sf, "links")).where("kind = 'calls'")
    roots = s.where("kind = 'constructor'").select("snapshot_id", F.col("id").alias("node"))
    return traverse.strongest_paths(calls, roots, s, max_depth=6, keep=1).select("root", "depth", "distinct_files", "distinct_categories", F.array_join("ids", ">").alias("ids"))


def reach_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """What every class reaches in four steps over exact links."""
    anchors = frame(spark, sf, "symbols").where("kind = 'class'").select("snapshot_id", F.col("id").alias("node"))
    edges = traverse.exact_edges(frame(spark, sf, "links"), contains=True)
    return traverse.neighbourhood(edges, anchors, max_symbols=None).select("anchor", "node", "hops")


def boundary_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What test components reach, passing through components of even size only."""
    c = frame(spark, sf, "components")
    roots = c.where("category = 'testing'").select("snapshot_id", F.col("category").alias("boundary"), F.col("path").alias("node"))
    through = c.where("code_lines % 2 = 0 or category = 'testing'").select("snapshot_id", F.col("path").alias("node"))
    return traverse.closure(frame(spark, sf, "edges"), roots, through=through).select("boundary", "node")


def hub_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The 1,000 nearest nodes of every supplier in the graph of all line items; suppliers are hubs, a search each."""
    anchors = frame(spark, sf, "supplier").select(F.lit("lines").alias("snapshot_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return traverse.neighbourhood(frame(spark, sf, "supplies"), anchors, max_symbols=1000).select("anchor", "node", "hops", "truncated")


def boundary_reach(spark: SparkSession, sf: str) -> DataFrame:
    """How many components each test component reaches, itself included."""
    roots = frame(spark, sf, "components").where("category = 'testing'").select("snapshot_id", F.col("path").alias("search"), F.col("path").alias("node"))
    return searches.reached(frame(spark, sf, "edges"), roots).select(F.col("search").alias("boundary"), "reached")


def dependency_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of every component resolved to files, by name and by their last part."""
    files = frame(spark, sf, "imports").select("snapshot_id", "path", F.array("raw").alias("imports"))
    return resolve.file_dependencies(files).select("src", "dst")


def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Calls resolved to symbols, dotted and bare names."""
    return resolve.resolve_names(frame(spark, sf, "named_links"), frame(spark, sf, "symbols")).select("edge_seq", "target_id", "resolution")


_RESOLVED = """
with s as (select * from {symbols} where kind <> 'file'), src as (select * from {symbols}),
 n as (select id, name t from s union select id, qualified_name from s),
 r as (select id, name t from s union select id, qualified_name from s union select id, 'src.' || split_part(split_part(path, '/', 2), '.', 1) || '.' || qualified_name from s union select id, split_part(split_part(path, '/', 2), '.', 1) || '.' || qualified_name from s),
 w as (select l.edge_seq, l.target_name t, src.path, src.language, src.parent_id, contains(l.target_name, '.') dotted from {named_links} l join src on src.id = l.source_id),
 c as (select w.*, s.id, s.path sp, s.start_line, s.qualified_name q, s.path = w.path in_path, s.language = w.language in_lang, s.path = w.path and s.parent_id is not distinct from w.parent_id in_parent
  from w join (select id, t, true d from r union all select id, t, false from n) x on x.t = w.t and x.d = w.dotted join s on s.id = x.id),
 a as (select edge_seq, any_value(dotted) dotted, count(*) filter (in_path and in_lang) npl, min((sp, start_line, q, id)) filter (in_path and in_lang) fpl, count(*) filter (in_path) np, min((sp, start_line, q, id)) filter (in_path) fp,
  count(*) filter (in_lang) nl, min((sp, start_line, q, id)) filter (in_lang) fl, count(*) filter (in_parent) npp, min((sp, start_line, q, id)) filter (in_parent) fpp, min((sp, start_line, q, id)) f from c group by edge_seq)
select w.edge_seq, case when a.edge_seq is null then null when a.dotted then (case when npl = 1 then fpl[4] when nl >= 1 then fl[4] else f[4] end) else (case when npp = 1 then fpp[4] when np = 1 then fp[4] when nl >= 1 then fl[4] else f[4] end) end target_id,
 case when a.edge_seq is null then 'unresolved' when a.dotted then (case when npl = 1 or nl = 1 then 'exact' else 'probable' end) else (case when npp = 1 or np = 1 then 'exact' else 'probable' end) end resolution
from w left join a using (edge_seq)"""


def semantic_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol and relationship counts, shares and the semantic index."""
    s = frame(spark, sf, "symbols").withColumn("value_distance", (F.substring("id", 2, 20).cast("int") % 9))
    return metrics.symbol_metrics(s, frame(spark, sf, "links"))


def chain_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two-step call chains of even orders against those of odd ones: added, removed and changed."""
    pairs = frame(spark, sf, "pairs")

    def chains(rest: int) -> DataFrame:
        rows = pairs.where(F.col("b") % 3 != rest)
        ids = F.array(F.concat(F.lit("s"), (F.col("a") % 17).cast("string")), F.concat(F.lit("m"), F.col("b").cast("string")),
            F.concat(F.lit("t"), (F.col("a") % 5).cast("string")))
        return compare.deepest_chains(rows.select(ids.alias("symbol_ids"), F.lit(2).alias("depth")))

    return compare.chain_changes(chains(0), chains(1))


_CHAINS = "select distinct 's' || (a % 17) || ' -> m' || b || ' -> t' || (a % 5) s, 's' || (a % 17) x, 't' || (a % 5) y from {{pairs}} where b % 3 <> {}"


def nearest_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol nearest to each of a file's declared lines."""
    places = frame(spark, sf, "part").select(
        F.lit("parts").alias("snapshot_id"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
            F.lit(".py")).alias("path"), ((F.col("p_partkey") * 13) % 400).cast("int").alias("line"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("bolt"), (F.col("p_partkey") % 50).cast("string"))).alias("name"), "p_partkey",
    )
    return surfaces.nearest_symbol(places, frame(spark, sf, "symbols")).select("p_partkey", "symbol_id")


_NEAREST = """
with p as (select p_partkey k, 'src/' || lower(replace(p_brand, '#', '')) || '.py' path, (p_partkey * 13) % 400 line, case when p_partkey % 4 = 0 then 'bolt' || (p_partkey % 50) end nm from {part}),
 c as (select k, id, case when name = nm or qualified_name = nm then 0 when start_line <= line and line <= end_line then 1 when line <= start_line and start_line <= line + 8 then 2 end t, start_line a, end_line - start_line w, line, qualified_name q
  from p join {symbols} s on s.path = p.path and s.kind not in ('file', 'module', 'namespace'))
select k p_partkey, id symbol_id from p left join (select k, id from c where t is not null
 qualify row_number() over (partition by k order by t, case t when 0 then abs(a - line) when 1 then w else a end, case when t = 2 then w else a end, a, w, q) = 1) using (k)"""


def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    """Module and callable names anchored at the one symbol that they mean."""
    wanted = frame(spark, sf, "part").select(
        F.lit("parts").alias("snapshot_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("module"),
        F.concat(F.split("p_name", " ")[1], (F.col("p_partkey") % 40).cast("string")).alias("callable"), "p_partkey"
    )
    return surfaces.module_symbol(wanted, frame(spark, sf, "symbols")).select("p_partkey", "symbol_id")


_SUFFIX = """
with p as (select p_partkey k, lower(replace(p_brand, '#', '')) || '.py' e, split_part(p_name, ' ', 2) || (p_partkey % 40) c from {part}),
 h as (select k, count(distinct id) n, min(id) one, count(distinct id) filter (parent_id is null) m, min(id) filter (parent_id is null) top from p join {symbols} s on ends_with(s.path, p.e) and (s.name = c or ends_with(qualified_name, '.' || c)) group by k)
select k p_partkey, case when n = 1 then one when m = 1 then top end symbol_id from p left join h using (k)"""


def page_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages written as route declarations, extracted again, merged and counted."""
    pages = frame(spark, sf, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    text = F.array_join(F.transform(found, lambda u: F.concat(F.lit('@app.get("'), u, F.lit('")'))), "\n")
    files = pages.select(F.lit("pages").alias("snapshot_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".py")).alias("path"),
        F.lit("python").alias("language"), text.alias("text"))
    return surfaces.routes(files).select("name", "path", "line")


_HREFS = """
with p as (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) u from {pages}), x as (select page_id, unnest(u) u, unnest(range(1, len(u) + 1)) line from p)
select 'GET ' || u as name, 'p' || page_id || '.py' as path, line::int line from x where u <> ''"""


def capability_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of pages by name: evidence joined, the first anchor, the first 200 of each host."""
    rows = page_routes(spark, sf)
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    found = rows.select(
        F.concat(F.lit("g"), (n % 7).cast("string")).alias("snapshot_id"), F.lit("http-route").alias("kind"), "name", F.lit("all").alias("path"),
        F.lit(1).alias("line"),
        F.when(n % 2 == 0, F.concat(F.lit("s"), n.cast("string"))).alias("symbol_id"), F.lit("route").alias("evidence_kind"),
        F.col("path").alias("detail"), (n * 1000 + F.col("line")).alias("seq"),
    )
    return surfaces.merge_capabilities(found).select("snapshot_id", "rank", "name", "symbol_id",
        F.array_join(F.transform("evidence", lambda e: e["detail"]), ",").alias("evidence"))


_MERGED = """
select g snapshot_id, k::int as "rank", name, symbol_id, evidence from (select *, row_number() over (partition by g order by lower(name), name) k from (
 select 'g' || (n % 7) g, name, min_by(case when n % 2 = 0 then 's' || n end, n * 1000 + line) filter (n % 2 = 0) symbol_id, string_agg(path, ',' order by n * 1000 + line) evidence
 from (select *, regexp_extract(path, '([0-9]+)', 1)::bigint n from (""" + _HREFS + """)) group by 1, 2)) where k <= 200"""


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every class, symbols of which three in four have a lifecycle verb, and their links."""
    s = frame(spark, sf, "symbols").withColumn("name",
        F.when(F.col("start_line") % 4 == 0, "saveAll").when(F.col("start_line") % 4 == 1, "normalize_it").when(F.col("start_line") % 4 == 2,
            "emit").otherwise(F.col("name")))
    return s.where("kind = 'class'").select("snapshot_id", F.col("id").alias("type_id")), s, frame(spark, sf, "links")


def journey_stages(spark: SparkSession, sf: str) -> DataFrame:
    """How many exact calls reach each stage of every class."""
    types, s, edges = _typed(spark, sf)
    return surfaces.journey_stages(surfaces.journeys(types, s, edges), types).select("type_id", "role", "events")


def journey_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every exact call in the journey of every class, with both ends, trust and evidence."""
    types, s, edges = _typed(spark, sf)
    return journeys.events(surfaces.journeys(types, s, edges), s).drop("snapshot_id", "relationship")


def journey_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Every class's members with a role, and whether an exact call reaches them."""
    return journeys.boundaries(*_typed(spark, sf)).drop("snapshot_id")


def recursive_chain_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty deepest recursive chains."""
    chains, names = traverse.deepest_recursive(frame(spark, sf, "symbols"), frame(spark, sf, "links"), keep=50)
    best = explore.semantic_chains(traverse.with_snapshot(chains, names), by="codes")
    return traverse.decoded(best.drop("snapshot_id"), names, "symbol_ids").select("rank", "depth", F.array_join("symbol_ids", ">").alias("chain"))


def edge_explorer(spark: SparkSession, sf: str) -> DataFrame:
    """The first eighty exact relationships of every class and what it contains."""
    types, _, edges = _typed(spark, sf)
    own = types.withColumnRenamed("type_id", "anchor")
    inside = edges.where("kind = 'contains' and resolution = 'exact'").select("snapshot_id", F.col("source_id").alias("anchor"), F.col("target_id").alias("id"))
    reached = own.withColumn("id", F.col("anchor")).union(inside.where("id is not null").join(own, ["snapshot_id", "anchor"], "left_semi"))
    return explore.edge_explorer(reached, edges).drop("snapshot_id")


def map_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, files and inversion of every folder of components."""
    c = frame(spark, sf, "components")
    return explore.folder_flags(c, metrics.directory_profiles(c)).select("folder", "code_lines", "files", "is_inversion")


_STAGES = """
with s as (select *, case start_line % 4 when 0 then 'persisted' when 1 then 'transformed' when 2 then 'emitted' end r0 from {symbols}), t as (select id from s where kind = 'class'),
 m as (select distinct l.source_id ty, s.id, case when s.kind = 'constructor' then 'created' else r0 end r from {links} l join s on s.id = l.target_id and s.kind <> 'file' where l.kind = 'contains' and l.resolution = 'exact'),
 e as (select id ty, id tgt, 'created' r from t union all select ty, id, r from m where r is not null and ty in (select id from t)),
 c as (select distinct ty, r, l.source_id, l.target_id from {links} l join e on e.tgt = l.target_id where l.kind = 'calls' and l.resolution = 'exact')
select t.id type_id, x.r as role, count(c.ty) events from t cross join (select unnest(['created', 'transformed', 'persisted', 'emitted']) r) x left join c on c.ty = t.id and c.r = x.r group by 1, 2"""


_VERBS = "case start_line % 4 when 0 then 'saveAll' when 1 then 'normalize_it' when 2 then 'emit' else name end v"
_TYPED = _STAGES[: _STAGES.index(",\n c as (")].replace("select *,", f"select *, {_VERBS},", 1)
_EVENTS = _TYPED + """,
 c as (select ty type_id, r as role, l.source_id, l.target_id, min_by(l.evidence, l.edge_seq) ev from {links} l join e on e.tgt = l.target_id where l.kind = 'calls' and l.resolution = 'exact' group by all)
select type_id, role, source_id, target_id, a.path source_path, a.start_line source_line, a.qualified_name source_name, b.path target_path, b.start_line target_line, b.qualified_name target_name,
 case when target_id = type_id then 'exact-call-to-data-type' else 'exact-call-to-lifecycle-member; role-from-member-name' end trust,
 case when target_id = type_id then ev || '; exact call resolves to selected ' || b.kind
  else ev || '; exact call resolves to contained member ' || chr(39) || b.qualified_name || chr(39) || '; role derived from member name ' || chr(39) || b.v || chr(39) end evidence
from c join s a on a.id = source_id join s b on b.id = target_id"""
_BOUNDARIES = _TYPED + """
select ty type_id, r as role, m.id, path, start_line line, qualified_name as name, 'exact member containment; lifecycle verb ' || chr(39) || v || chr(39) evidence,
 m.id in (select target_id from {links} where kind = 'calls' and resolution = 'exact' and target_id is not null and source_id in (select id from s)) called
from m join s on s.id = m.id where r is not null and ty in (select id from t)"""
_EDGES_OF = """
with x as (select source_id, target_id, kind, evidence from {links} where resolution = 'exact' and target_id is not null), t as (select id from {symbols} where kind = 'class'),
 r as (select id anchor, id from t union select source_id, target_id from x where kind = 'contains' and source_id in (select id from t)),
 n as (select anchor, source_id, target_id, x.kind, evidence, row_number() over (partition by anchor order by source_id, target_id, x.kind, evidence) k, count(*) over (partition by anchor) c from r join x on x.source_id = r.id)
select anchor, k::int as "rank", source_id, target_id, kind, evidence, greatest(c - 80, 0)::bigint more from n where k <= 80"""
_FOLDERS = f"""
with p as (select unnest([array_to_string(string_split(path, '/')[1:n], '/') for n in range(1, len(string_split(path, '/')))]) folder, code_lines, category from {{components}})
select folder, sum(code_lines)::bigint code_lines, count(*) files, folder in (select path from ({measure_queries._PROFILED}) where is_inversion) is_inversion from p group by folder"""


def literal_references(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that texts name, with the form they use: files of a tree of odd names mention each other rightly and wrongly."""
    paths = frame(spark, sf, "tree").select("snapshot_id", F.concat_ws("/", "branch", "twig", "leaf").alias("path"))
    texts = frame(spark, sf, "mentions").groupBy("snapshot_id", F.col("src").alias("path")).agg(
        F.concat(F.lit("run "), F.array_join(F.sort_array(F.collect_list("mention")), "; sh "), F.lit("\n")).alias("text"))
    files = paths.join(texts, ["snapshot_id", "path"], "left")
    # texts come out of a small shuffle; their words are spread over tasks again
    files = spread(files, "path")
    return references.literal_references(files).select("src", "dst", "form")


_NAMED = """
with f as (select concat(branch, '/', twig, '/', leaf) path from {tree}), t as (select src, concat('run ', string_agg(mention, '; sh '), chr(10)) body from {mentions} group by src),
 c as (select src, path dst, body, string_split(src, '/')[:-2] sp, string_split(path, '/') tp from t join f on contains(body, string_split(path, '/')[-1]) and src <> path),
 k as (select *, len(list_filter(range(1, len(sp) + 1), lambda i: sp[1:i] = tp[1:i])) same from c),
 r as (select *, repeat('../', len(sp) - same) || array_to_string(tp[same + 1:], '/') short from k),
 w as (select src, dst, body, unnest(list_distinct([dst, './' || dst, short, case when starts_with(short, '.') then short else './' || short end])) form from r)
select src, dst, form from w where regexp_matches(body, concat(case when contains(form, '/') then '(^|[^A-Za-z0-9_.-])' else '(^|[^A-Za-z0-9_./-])' end, regexp_escape(form), '($|[^A-Za-z0-9_./-])'))
qualify row_number() over (partition by src, dst order by length(form) desc, form) = 1"""


def use_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many evidence rows of each of the six kinds every file has; user-surface classes are the capabilities."""
    c, symbols, links, edges = (frame(spark, sf, n, shuffled=True) for n in ("components", "symbols", "links", "edges"))
    texts = edges.groupBy("snapshot_id", "src").agg(F.concat(F.lit("run "), F.array_join(F.sort_array(F.collect_list("dst")), "; sh ./")).alias("text"))
    files = c.select("snapshot_id", "path", "category").join(texts.withColumnRenamed("src", "path"), ["snapshot_id", "path"], "left").fillna("", ["text"])
    files = apart(files)
    found = symbols.where("kind = 'class' and category = 'user-surface'").select("snapshot_id", F.lit("user-surface").alias("kind"),
        F.col("id").alias("name"), "path", F.col("id").alias("symbol_id"))
    reached = surfaces.implementation(found, symbols, links, max_symbols=None)
    rows = metabolism.structural_use(symbols, links, edges).unionByName(metabolism.capability_use(found, symbols, reached)).unionByName(references.use(files))
    return rows.groupBy("path", "kind").agg(F.count("*").alias("evidence"), F.min("source").alias("first_source"))


_USE = f"""
with recursive k as (select path, category from {{components}}), e as (select distinct src, dst from {{edges}}), x as (select distinct a, b from {_EXACT}), s as (select id, path, kind, category from {{symbols}}),
 ev as (select distinct source_id a, target_id b, kind, evidence from {{links}} where resolution = 'exact' and target_id is not null and kind <> 'contains'),
 cap as (select id, path from s where kind = 'class' and category = 'user-surface'),
 w(anchor, node, h) as (select id, id, 0 from cap union select anchor, x.b, h + 1 from w join x on x.a = w.node where h < 4),
 roots as (select path from k where category = 'testing'),
 r(node) as (select dst from e where src in (select path from roots) union select e.dst from r join e on e.src = r.node),
 rows as (
  select distinct t.path, 'exact_semantic_inbound' kind, o.path source, ev.kind || ': ' || ev.evidence detail from ev join s t on t.id = ev.b join s o on o.id = ev.a where t.path <> o.path
  union all select distinct dst, 'local_dependency_inbound', src, '' from e where src <> dst
  union all select distinct path, 'capability_surface', 'user-surface', id from cap
  union all select distinct s.path, 'capability_reachable', 'user-surface', anchor from w join s on s.id = w.node
  union all select distinct dst, 'static_path_references', src, '' from e where src in (select path from roots)
  union all select distinct dst, 'boundary_path_references', src, '' from e where src in (select node from r))
select path, kind, count(*) evidence, min(source) first_source from rows group by 1, 2"""


QUERIES = {
    "value_distance": (value_distance, _HOPS + f" select path, category, greatest({_BASE}, coalesce(h, 0))::int value_distance from {{components}} left join d on node = p_partkey"),
    "audit_chain_depth": (audit_chain_depth, _WALKS + " select root, max(depth)::int max_depth from c group by root"),
    "audit_chain_topk": (audit_chain_topk, _WALKS + """,
 t as (select paths, depth, sum(k.code_lines)::bigint total_lines from (select paths, depth, unnest(paths) p from c) join k on k.path = p group by paths, depth),
 x as (select distinct list_slice(paths, 1, n) paths from (select paths, unnest(range(2, len(paths))) n from c)),
 l as (select *, array_to_string(paths, ' > ') chain from t anti join x using (paths))
select row_number() over (order by depth desc, total_lines desc, paths)::int as "rank", depth::int depth, total_lines, chain from l qualify row_number() over (order by depth desc, total_lines desc, paths) <= 25"""),
    "audit_budget": (audit_budget, f"select 'parts' snapshot_id, least(count(*), 3) expansions, count(*) > 3 truncated from {{edges}} e join {{components}} a on a.path = e.dst and a.category in {_in(PRODUCT)} join {{components}} b on b.path = e.src and b.category in {_in(RECURSIVE)}"),
    "symbol_distance": (symbol_distance, _NEAR + " select id, kind, category, h::int value_distance from {symbols} left join d on node = id"),
    "recursive_chain_depth": (recursive_chain_depth, _CALLERS + " select root, max(len(ids) - 1)::int max_depth, count(*) chains from c group by root"),
    "value_path_topk": (value_path_topk, f"""
with recursive e as (select distinct a, b from {_EXACT} where kind = 'calls'), w(root, node, ids) as (select id, id, [id] from {{symbols}} where kind = 'constructor'
  union all select root, e.b, list_append(ids, e.b) from w join e on e.a = w.node where not list_contains(ids, e.b) and len(ids) <= 6),
 f as (select root, ids from w where len(ids) = 7 or not exists (select 1 from e where e.a = w.node and not list_contains(w.ids, e.b))),
 n as (select root, ids, len(ids) - 1 depth, count(distinct path) distinct_files, count(distinct category) distinct_categories from (select root, ids, unnest(ids) id from f) left join {{symbols}} using (id) group by root, ids)
select root, depth::int depth, distinct_files, distinct_categories, array_to_string(ids, '>') ids from n qualify row_number() over (partition by root order by depth desc, distinct_files desc, distinct_categories desc, ids) = 1"""),
    "reach_neighbourhood": (reach_neighbourhood, f"""
with recursive e as (select distinct a, b from {_EXACT} where a <> b), w(anchor, node, h) as (select id, id, 0 from {{symbols}} where kind = 'class' union select anchor, e.b, h + 1 from w join e on e.a = w.node where h < 4)
select anchor, node, min(h)::int hops from w group by 1, 2"""),
    "boundary_closure": (boundary_closure, """
with recursive k as (select path, category, code_lines from {components}), e as (select distinct src, dst from {edges} join k on k.path = src and (k.code_lines % 2 = 0 or k.category = 'testing')),
 w(node) as (select path from k where category = 'testing' union select dst from w join e on e.src = w.node)
select 'testing' boundary, node from w"""),
    "hub_reach": (hub_reach, """
with recursive e as (select src, dst from {supplies}), w(anchor, node, h) as (select concat('s', s_suppkey), concat('s', s_suppkey), 0 from {supplier} union select anchor, e.dst, h + 1 from w join e on e.src = w.node where h < 4),
 m as (select anchor, node, min(h)::int hops from w group by 1, 2)
select anchor, node, hops, count(*) over (partition by anchor) > 1000 truncated from m qualify row_number() over (partition by anchor order by hops, node) <= 1000"""),
    "boundary_reach": (boundary_reach, """
with recursive e as (select distinct src, dst from {edges}), w(boundary, node) as (select path, path from {components} where category = 'testing' union select boundary, dst from w join e on e.src = w.node)
select boundary, count(*) reached from w group by 1"""),
    "dependency_resolve": (dependency_resolve, """
with i as (select path, p_partkey, raw, split_part(raw, '.', 1) m, split_part(raw, '.', 2) t from {imports}), f as (select path, split_part(split_part(path, '/', 3), '.', 1) stem, split_part(path, '/', 2) b from i)
select distinct i.path src, f.path dst from i join f on f.stem = i.t where f.path <> i.path"""),
    "resolve_names": (resolve_names, _RESOLVED),
    "semantic_metrics": (semantic_metrics, f"""
with s as (select *, (substring(id, 2)::int % 9) vd from {{symbols}} where kind <> 'file'), l as (select * from {{links}} where kind <> 'contains'),
 a as (select snapshot_id, count(*) symbol_count, count(*) filter (category in {_in(PRODUCT)}) product_symbols, count(*) filter (category in {_in(MACHINERY)}) machinery_symbols, count(*) filter (category in {_in(AUDIT)}) audit_symbols,
  count(*) filter (category = 'meta-machinery') meta_symbols, count(vd) product_reachable_symbols, count(*) filter (vd >= 4 and category in {_in(RECURSIVE)}) far_from_value_symbols, max(vd)::int max_value_distance from s group by 1),
 b as (select snapshot_id, count(*) relationship_count, count(*) filter (resolution = 'exact') resolved_relationships, count(*) filter (resolution = 'probable') probable_relationships, count(*) filter (resolution = 'unresolved') unresolved_relationships from l group by 1),
 c as (select *, 0::int max_recursive_depth, product_symbols / symbol_count direct_product_symbol_share, machinery_symbols / symbol_count machinery_symbol_share, audit_symbols / symbol_count audit_symbol_share, meta_symbols / symbol_count meta_symbol_share,
  machinery_symbols / product_symbols scaffolding_symbol_ratio, far_from_value_symbols / symbol_count far_from_value_symbol_share, (resolved_relationships + probable_relationships) / relationship_count resolution_rate,
  resolved_relationships / relationship_count exact_resolution_rate, resolved_relationships / relationship_count exact_coverage from a join b using (snapshot_id))
select *, 100.0::double * least(1.0::double, 0.40::double * audit_symbol_share + 0.25::double * meta_symbol_share * 2.0::double + 0.20::double * far_from_value_symbol_share + 0.15::double * 0.0::double) semantic_recursion_index from c"""),
    "chain_diff": (chain_diff, f"""
with o as ({_CHAINS.format(0)}), n as ({_CHAINS.format(1)}), a as (select *, row_number() over (partition by x, y order by s) k from n where s not in (select s from o)), r as (select *, row_number() over (partition by x, y order by s) k from o where s not in (select s from n))
select case when r.s is null then 'added' when a.s is null then 'removed' else 'changed' end as "change", r.s as "before", a.s as "after" from a full join r using (x, y, k)"""),
    "nearest_interval": (nearest_interval, _NEAREST),
    "suffix_join": (suffix_join, _SUFFIX),
    "page_routes": (page_routes, _HREFS),
    "capability_dedup": (capability_dedup, _MERGED),
    "journey_stages": (journey_stages, _STAGES),
    "journey_events": (journey_events, _EVENTS),
    "journey_boundaries": (journey_boundaries, _BOUNDARIES),
    "recursive_chain_topk": (recursive_chain_topk,
        _CALLERS + """ select row_number() over (order by len(ids) desc, ids)::int as "rank", (len(ids) - 1)::int as "depth", array_to_string(ids, '>') chain from c qualify row_number() over (order by len(ids) desc, ids) <= 50"""),
    "edge_explorer": (edge_explorer, _EDGES_OF),
    "map_folders": (map_folders, _FOLDERS),
    "use_evidence": (use_evidence, _USE),
    "literal_references": (literal_references, _NAMED),
}
