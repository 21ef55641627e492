"""Relations of the library's data model derived from the given tables, as SQL that Spark and DuckDB both read.

``{name}`` stands for a given table or another proxy.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from codemass.functions.spread import apart
from codemass.schema import CATEGORIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations")


def _case(number: str, values: tuple[str, ...]) -> str:
    return f"case {number} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


_PATH = "concat('src/', lower(replace(p_brand, '#', '')), '/', lower(p_type), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey as string), '.py')"
_PRIORITY = "case substring(o_orderpriority, 1, 1) when '1' then 'core-product' when '2' then 'user-surface' when '3' then 'testing' when '4' then 'process-machinery' else 'documentation' end"
_SEGMENT = "case c_mktsegment when 'HOUSEHOLD' then 'core-product' when 'MACHINERY' then 'developer-tooling' when 'BUILDING' then 'essential-support' when 'AUTOMOBILE' then 'audit-provenance' else 'verification' end"

SQL = {
    "components": f"""
select 'parts' as snapshot_id, p_partkey, {_PATH} as path, 'python' as language, cast(p_size as bigint) as code_lines,
 {_case("p_partkey % 12", CATEGORIES)} as category, cast(p_size % 6 as int) as value_distance from {{part}}""",
    # every line item gives an edge; those of a part go to five parts at most, as a file depends on few others
    "pairs": """
select distinct l_partkey as a, (l_partkey * 7 + l_suppkey % 5) % (select count(*) from {part}) as b
from {lineitem}""",
    "edges": """
select 'parts' as snapshot_id, x.path as src, y.path as dst from {pairs} e join {components} x on x.p_partkey = e.a join {components} y on y.p_partkey = e.b where e.a <> e.b""",
    # suppliers are hubs: each has hundreds of parts, and a part leads back to all of its suppliers
    "supplies": """
with l as (select distinct concat('s', cast(l_suppkey as string)) as s, concat('p', cast(l_partkey as string)) as p from {lineitem})
select 'lines' as snapshot_id, s as src, p as dst from l union all select 'lines' as snapshot_id, p as src, s as dst from l""",
    "symbols": f"""
select 'parts' as snapshot_id, concat('s', cast(p_partkey as string)) as id, concat('src/', lower(replace(p_brand, '#', '')), '.py') as path,
 case when p_partkey % 5 = 0 then 'go' else 'python' end as language,
 {_case("p_partkey % 7", ("file", "class", "function", "method", "constructor", "function", "class"))} as kind,
 concat(split_part(p_name, ' ', 2), cast(p_partkey % 40 as string)) as name,
 concat(split_part(p_name, ' ', 1), '.', split_part(p_name, ' ', 2), cast(p_partkey % 40 as string)) as qualified_name,
 cast(p_partkey % 300 as int) as start_line, cast(p_partkey % 300 + p_size as int) as end_line,
 case when p_partkey % 3 = 0 then null else concat('s', cast(p_partkey % 25 as string)) end as parent_id,
 {_case("p_partkey % 12", CATEGORIES)} as category from {{part}}""",
    "links": """
select distinct 'parts' as snapshot_id, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey as edge_seq, concat('s', cast(l_partkey as string)) as source_id,
 case (l_orderkey + l_linenumber) % 5 when 0 then 'calls' when 1 then 'imports' when 2 then 'inherits' when 3 then 'contains' else 'calls' end as kind,
 '' as target_name, case when l_returnflag = 'N' then null else concat('s', cast((l_partkey * 7 + l_suppkey % 5) % (select count(*) from {part}) as string)) end as target_id,
 case l_returnflag when 'A' then 'exact' when 'R' then 'probable' else 'unresolved' end as resolution, l_linestatus as evidence
from {lineitem}""",
    "named_links": """
select distinct 'parts' as snapshot_id, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey as edge_seq, concat('s', cast(l_partkey as string)) as source_id, 'calls' as kind,
 case when l_orderkey % 3 = 0 then concat(split_part(p_name, ' ', 1), '.', split_part(p_name, ' ', 2), cast(l_suppkey % 45 as string))
  else concat(split_part(p_name, ' ', 2), cast(l_suppkey % 45 as string)) end as target_name,
 cast(null as string) as target_id, 'unresolved' as resolution, '' as evidence
from {lineitem} join {part} on p_partkey = l_partkey""",
    "imports": """
select 'parts' as snapshot_id, concat('src/', lower(replace(p_brand, '#', '')), '/mod', cast(p_partkey as string), '.py') as path, p_partkey,
 concat(case when p_partkey % 3 = 0 then 'elsewhere' else lower(replace(p_brand, '#', '')) end, '.mod', cast((p_partkey * 3 + 1) % (select count(*) from {part}) as string)) as raw from {part}""",
    # a tree with characters of every kind in its folders and names
    "tree": """
select 'parts' as snapshot_id, p_partkey, concat('src/', case p_partkey % 4 when 0 then '(' when 1 then '@' else '' end, lower(replace(p_brand, '#', '')), case p_partkey % 4 when 0 then ')' else '' end) as branch,
 lower(p_type) as twig, case p_partkey % 5 when 0 then concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as string), '.py') when 1 then concat(p_name, ' ', cast(p_partkey as string), '.py')
 when 2 then concat('é', cast(p_partkey as string), '.sh') when 3 then concat('[', p_name, ']/', cast(p_partkey as string), '.tsx') else concat('a', cast(p_partkey as string), '.c++') end as leaf from {part}""",
    # how one file of the tree names another: from the root, from its folder, behind a variable, and in ways that are no reference
    "mentions": """
select x.snapshot_id, concat(x.branch, '/', x.twig, '/', x.leaf) as src, concat(y.branch, '/', y.twig, '/', y.leaf) as dst, concat(
 case (e.a + e.b * 3) % 8 when 1 then './' when 3 then '$ROOT/' when 4 then 'x' when 6 then 'foo/../' else '' end,
 case when (e.a + e.b * 3) % 8 not in (2, 6, 7) then concat(y.branch, '/', y.twig, '/', y.leaf) when x.branch = y.branch and x.twig = y.twig and not (contains(x.leaf, '/') or contains(y.leaf, '/')) then y.leaf
  else concat(case when contains(x.leaf, '/') then '../../../' else '../../' end, substring(y.branch, 5), '/', y.twig, '/', y.leaf) end,
 case (e.a + e.b * 3) % 8 when 5 then '.bak' else '' end) as mention
from {pairs} e join {tree} x on x.p_partkey = e.a join {tree} y on y.p_partkey = e.b""",
    "files": """
select 'docs' as snapshot_id, doc_id, concat(source, '/', lang, '/doc_', cast(doc_id as string), '.md') as path,
 case lang when 'en' then 'c' when 'fr' then 'shell' when 'de' then 'sql' else 'markdown' end as language, coalesce(text, '') as text from {documents}""",
    "measured": f"""
select n_name as repository, cast(extract(year from o_orderdate) as string) as sha, cast(extract(year from o_orderdate) as int) as frame, max(o_orderdate) as scanned_at,
 {_PRIORITY} as category, {_SEGMENT} as role, count(*) as n
from {{orders}} join {{customer}} on c_custkey = o_custkey join {{nation}} on n_nationkey = c_nationkey group by n_name, extract(year from o_orderdate), {_PRIORITY}, {_SEGMENT}""",
    "frames": f"""
select r_name as repository, cast(extract(year from o_orderdate) - 1995 as int) as frame, n_name as path, {_PRIORITY} as category, count(*) as code_lines
from {{orders}} join {{customer}} on c_custkey = o_custkey join {{nation}} on n_nationkey = c_nationkey join {{region}} on r_regionkey = n_regionkey
group by r_name, extract(year from o_orderdate), n_name, {_PRIORITY}""",
    "use": f"""
select 'events' as repository, cast(extract(day from ts) as int) - 1 as frame, concat('u/v', lpad(cast(user_id as string), 4, '0'), '.md') as path,
 {_case("user_id % 12", CATEGORIES)} as category, cast(count(*) as bigint) as code_lines,
 max(case when event_type in ('purchase', 'signup') then 1 else 0 end) = 1 and user_id % 4 <> 0 as active,
 concat(cast(count(*) as string), ':', cast(min(event_id) % 3 as string)) as print
from {{events}} group by extract(day from ts), user_id""",
}


@cache
def uses(name: str) -> tuple[str, ...]:
    """The tables and proxies that a proxy reads."""
    return tuple(k for k in (*TABLES, *SQL) if "{" + k + "}" in SQL.get(name, ""))


def frame(spark: SparkSession, sf_dir: str, name: str, *, shuffled: bool = False) -> DataFrame:
    """A given table or a proxy as a DataFrame; ``shuffled``: so that joins in it and of it broadcast none of its tables."""
    if name not in SQL:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        df = spark.sql(SQL[name], **{k: frame(spark, sf_dir, k, shuffled=shuffled) for k in uses(name)})
    return apart(df) if shuffled else df


def expand(sql: str) -> str:
    """DuckDB SQL with every proxy in it written out."""
    while any("{" + k + "}" in sql for k in SQL):
        for k in SQL:
            sql = sql.replace("{" + k + "}", f"({SQL[k].strip()})")
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
