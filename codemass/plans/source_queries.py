"""Queries that parse sources made from the given tables: every order is a file, every line item a function in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.functions.spread import spread
from codemass.plans.proxies import frame
from codemass.sources import braces

#: Of each of four languages: suffix, first line, a function (its number, what it calls), last line.  Strings and comments hold braces.
_FORMS = (
    ("java", ("class O", " {\n"), ("  int m", "(int q) {\n    return f", '("{" + q); // }\n  }\n'), "}\n"),
    ("typescript", ("export class O", " {\n"), ("  async m", "(q: number): Promise<number> {\n    return f", "(`{` + q); /* } */\n  }\n"), "}\n"),
    ("go", ("package o", "\n"), ("func m", "(q int) int {\n    return f", "('{', q) // }\n}\n"), ""),
    ("rust", ("pub struct O", " { a: i32 }\n"), ("fn m", "<'a>(q: &'a str) -> i32 {\n    f", "('{', q) /* } */\n}\n"), ""),
)


def brace_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of every order's source with their lines, and how often and what first each calls."""
    lines = frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kind = F.col("l_orderkey") % len(_FORMS)
    pick = lambda made: F.coalesce(*[F.when(kind == k, made(*form[1:])) for k, form in enumerate(_FORMS)])
    number = lambda c: F.col(c).cast("string")
    line = lambda x, first, f, last: F.concat(F.lit(f[0]), x["l_linenumber"].cast("string"), F.lit(f[1]), x["l_partkey"].cast("string"), F.lit(f[2]))
    # numbers are shuffled once; a file's text is made, and walked, where its lines have met
    orders = spread(lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("f"))
    text = pick(lambda first, f, last: F.concat(F.lit(first[0]), number("l_orderkey"), F.lit(first[1]), F.array_join(F.transform("f", lambda x: line(x, first, f, last)), ""), F.lit(last)))
    language = F.element_at(F.array(*[F.lit(form[0]) for form in _FORMS]), (kind + 1).cast("int"))
    files = orders.select(F.lit("orders").alias("snapshot_id"), F.concat(F.lit("o"), number("l_orderkey")).alias("path"), language.alias("language"), text.alias("text"),
        (F.size("f") * 3 + 2).cast("int").alias("lines"))
    return braces.outlines(files).drop("snapshot_id")


_SYMBOLS = """
with l as (select l_orderkey o, l_linenumber n, l_partkey p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) r, count(*) over (partition by l_orderkey) many from lineitem)
select 'o' || o path, case o % 4 when 0 then 'method' when 1 then 'method' else 'function' end kind, case when o % 4 < 2 then 'O' || o || '.m' || n else 'm' || n end qualified_name,
 (3 * r - 1)::int start_line, (3 * r + 1)::int end_line, 1::bigint calls, 'f' || p first_call from l
union all select distinct 'o' || o, case o % 4 when 3 then 'struct' else 'class' end, 'O' || o, 1, (case o % 4 when 3 then 1 else 3 * many + 2 end)::int, 0::bigint, null from l where o % 4 <> 2"""

QUERIES = {"brace_symbols": (brace_symbols, _SYMBOLS)}
