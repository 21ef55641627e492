"""Queries of line, token and phrase functions and of file classification, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.functions import scalars, text
from codemass.functions.spread import spread
from codemass.operators import classify
from codemass.plans.proxies import frame


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and code lines of every text, read as the language that its own one stands for."""
    f = frame(spark, sf, "files").withColumn("lines", text.lines_of("text"))
    return f.select("doc_id", F.size("lines").alias("lines"), text.code_lines("lines", "language").alias("code_lines"))


_LINES = r"""
with f as (select doc_id, language, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') l from {files}), g as (select doc_id, language, case when l[-1] = '' then l[1:len(l) - 1] else l end l from f)"""
_CODE = _LINES + r"""
select doc_id, len(l)::int lines, len(list_filter(list_transform(l, lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')), lambda x: x <> '' and not (language = 'c' and starts_with(x, '//'))
 and not (language = 'shell' and starts_with(x, '#')) and not (language = 'sql' and starts_with(x, '--'))))::int code_lines from g"""


def path_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of every component's path."""
    c = frame(spark, sf, "components")
    return c.select("path", F.array_join(F.array_sort(text.tokens("path")), " ").alias("tokens"))


def ngram_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every path and their joins of two and three, camel case split."""
    c = frame(spark, sf, "components").select("path", F.concat(F.lit("getV2"), F.initcap(F.element_at(F.split("path", "/"), -1))).alias("v"))
    return c.select("path", F.array_join(F.array_sort(text.gram_tokens("v")), " ").alias("tokens"))


_GRAMS = """
with c as (select path, string_split_regex(trim(regexp_replace(lower(regexp_replace('getV2' || upper(n[1]) || lower(n[2:]), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ') p from (select path, list_last(string_split(path, '/')) n from {components}))
select path, array_to_string(list_sort(list_distinct(p || list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]) || list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2]))), ' ') tokens from c"""

_PHRASES = ("th", "on", "re", "ion", "the an", "ing", "able", "and", "la", "ci")


def phrase_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Which phrases every text holds."""
    f = frame(spark, sf, "files").withColumn("low", F.lower("text"))
    return f.select("doc_id", *[text.phrase_hit("low", p).alias("p_" + p.replace(" ", "_")) for p in _PHRASES])


def _hit(p: str, column: str) -> str:
    if " " in p:
        return f"contains({column}, '{p}')"
    end = r"([^\p{L}\p{N}_\p{M}]|$)" if len(p) < 4 else ""
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_\p{{M}}]){p}{end}')"


def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often machinery words occur in every text."""
    return frame(spark, sf, "files").select("doc_id", text.mentions(F.lower("text")).alias("n"), text.mentions(F.lower("text"), ("th", "ion", "er")).alias("m"))


_COUNT = lambda ws: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ws)


def classify_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The purpose of every document as a file, and of every component by its path."""
    docs = frame(spark, sf, "files").select("snapshot_id", "path", F.lit("markdown").alias("language"), "text")
    # rows of few bytes, many words to look for in each
    parts = spread(frame(spark, sf, "part")).select(
        F.lit("docs").alias("snapshot_id"), F.concat(
            F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("p_partkey") % len(_FOLDERS) + 1).cast("int")), F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.lit("python").alias("language"), F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int")).alias("text"),
    )
    return classify.classify(docs.union(parts), head=None).select("path", "category", F.round("confidence", 9).alias("confidence"),
        F.size("signals").alias("signals"))


_FOLDERS = ("src/game", "tests", "docs", ".github/flows", "ui/views", "auditAuditor", "tools", "lib", "storage/cache", "validatorValidator",
    "telemetry", "release")
_TEXTS = ("x = 1", "def verify(): audit report; validate report; audit verify checker workflow", "render the page and load config from storage",
    "pipeline for release; ci; deploy", "", "test fixtures and mocks assert", "game engine with player inventory", "log metrics trace span; diagnostic")


def _classify_sql() -> str:
    """The same rules written out as SQL."""
    rows, n = [], 0

    def add(category: str, weight: str) -> None:
        nonlocal n
        rows.append(f"struct_pack(c := '{category}', w := {weight}, s := {n})")
        n += 1

    add("documentation", "case when language in ('markdown', 'documentation') then 7.0::double end")
    add("process-machinery", "case when starts_with(path, '.github/') then 8.0::double end")
    for category, phrases in classify.RULES.items():
        at_path = "(" + " + ".join("(" + " and ".join(f"list_contains(k, '{t}')" for t in classify._tokens_of(p)) + ")::int" for p in phrases) + ")"
        inside = "(" + " + ".join(f"({_hit(p, 't')})::int" for p in phrases) + ")"
        add(category, f"case when {at_path} > 0 then {classify.PATH_WEIGHT[category]}::double + least(2.0::double, 0.35::double * ({at_path} - 1)) end")
        add(category, f"case when {inside} > 0 then least(3.6::double, 0.55::double + log2(1.0::double + {inside})) end")
    for category, words, weight, _ in classify.FOLDERS:
        add(category, f"case when list_has_any(k, {list(words)!r}) then {weight}::double end")
    deep = "(" + " + ".join(f"contains(t, '{p}')::int" for p in classify.RECURSIVE_PHRASES) + ")"
    add("meta-machinery", f"case when {deep} > 0 and {_COUNT(text.MACHINERY_WORDS)} >= 4 then 4.5::double + least(2.5::double, {deep} * 0.6::double) end")
    folders, texts = list(_FOLDERS), list(_TEXTS)
    return f"""
with f as (select path, 'markdown' as language, lower(text) t from {{files}} union all select {folders!r}[p_partkey % {len(folders)} + 1] || '/' || replace(p_name, ' ', '_') || p_partkey || '.py', 'python', lower({texts!r}[p_partkey % {len(texts)} + 1]) from {{part}}),
 g as (select *, list_distinct(string_split_regex(trim(regexp_replace(lower(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')) k from f),
 s as (select path, unnest([{", ".join(rows)}]) r from g), u as (select path, r.c, r.w, r.s from s where r.w is not null),
 v as (select path, c, list_reduce(list(w order by s), lambda a, b: a + b) w, min(s) s, count(*) n from u group by 1, 2), x as (select path, c, case when c = 'testing' and w >= 7 then w + 4 else w end w, s, n from v),
 z as (select path, c, w, coalesce(lead(w) over o, 0.0::double) w2, row_number() over o k, sum(n) over (partition by path) n from x window o as (partition by path order by w desc, s))
select f.path, coalesce(c, 'unknown') category, round(coalesce(least(0.99::double, 0.42::double + 0.08::double * w + 0.06::double * greatest(0.0::double, w - w2)), 0.0::double), 9) confidence, coalesce(least(n, 8), 0)::int signals from f left join (select * from z where k = 1) z using (path)"""


def generated_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an html page's first lines say that it is generated, a comment put before some."""
    head = F.when(F.col("page_id") % 3 == 0, "// Code generated by x\n").when(F.col("page_id") % 3 == 1, "do not edit\n").otherwise("")
    p = frame(spark, sf, "pages").select("page_id", text.lines_of(F.concat(head, F.coalesce("html", F.lit("")))).alias("l"))
    return p.select("page_id", text.looks_generated("l").alias("generated"))


def module_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names that every component may be imported by, and its last part."""
    c = frame(spark, sf, "components")
    return c.select("path", F.array_join(F.array_sort(text.module_aliases("path")), " ").alias("aliases"), text.tail("path").alias("tail"))


def target_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of conversation texts as call targets: normalised and shortened."""
    t = frame(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("  new "), F.col("text"), F.lit("::Run(); ")).alias("t"), "text")
    return t.select("conv_id", "turn", text.normal_target(F.translate("t", "\n", " ")).alias("target"), F.length(text.compact("text")).alias("n"))


def member_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Events by the stage that their kind's first word names."""
    e = frame(spark, sf, "events").select(F.when(F.col("event_type") == "view", "renderView").when(F.col("event_type") == "click",
            "apply_click").when(F.col("event_type") == "purchase", "SaveOrder").when(F.col("event_type") == "signup",
            "create-user").otherwise("x").alias("name"), F.when(F.col("event_id") % 97 == 0, "constructor").otherwise("method").alias("kind"))
    return e.withColumn("role", scalars.member_role("kind", "name")).groupBy("name", "role").agg(F.count("*").alias("n"))


def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """Urls as archive members: which names are safe, which repositories and hashes are well formed."""
    p = frame(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "^https?://", F.lit("")).alias("m"))
    m = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), F.col("m"))).when(F.col("page_id") % 5 == 1,
        F.concat(F.lit("/"), F.col("m"))).otherwise(F.col("m"))
    return p.select("page_id", scalars.safe_member(m).alias("safe"), scalars.safe_member("url").alias("safe_url"),
        scalars.is_repository(F.concat_ws("/", F.split("m", "/")[0], F.split("m", "/")[1])).alias("repository"), scalars.is_sha(F.sha1("url")).alias("sha"))


QUERIES = {
    "code_lines": (code_lines, _CODE),
    "path_tokens": (path_tokens, "select path, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(path), '[a-z0-9]+'))), ' ') tokens from {components}"),
    "ngram_tokens": (ngram_tokens, _GRAMS),
    "phrase_hits": (phrase_hits, "with f as (select doc_id, lower(text) t from {files}) select doc_id, " + ", ".join(
            f"{_hit(p, 't')} p_{p.replace(' ', '_')}" for p in _PHRASES) + " from f"),
    "mention_counts": (mention_counts, f"with f as (select doc_id, lower(text) t from {{files}}) select doc_id, ({_COUNT(text.MACHINERY_WORDS)})::bigint n, ({_COUNT(('th', 'ion', 'er'))})::bigint m from f"),
    "classify_argmax": (classify_argmax, _classify_sql()),
    "generated_headers": (generated_headers, "select page_id, page_id % 3 = 0 as generated from {pages}"),
    "module_names": (module_names, "with c as (select path, regexp_replace(path, '\\.py$', '') s from {components}) select path, array_to_string(list_sort(list_distinct([s, replace(s, '/', '.'), s[5:], replace(s[5:], '/', '.')])), ' ') aliases, 'py' as tail from c"),
    "target_names": (target_names, r"""with t as (select conv_id, turn, regexp_replace(trim(replace('  new ' || text || '::Run(); ', chr(10), ' ')), '[;(){}\[\]]+$', '') t, text from {conversations})
select conv_id, turn, regexp_replace(regexp_replace(list_last(string_split(trim(regexp_replace(replace(replace(t, '::', '.'), '->', '.'), '\s+', ' ', 'g')), ' ')), '^\.+', ''), '\.+$', '') as target, least(length(trim(regexp_replace(text, '\s+', ' ', 'g'))), 180)::int n from t"""),
    "member_roles": (member_roles, """select name, case when k then 'created' else case name when 'renderView' then 'emitted' when 'apply_click' then 'transformed' when 'SaveOrder' then 'persisted' when 'create-user' then 'created' end end as role, count(*) n
from (select case event_type when 'view' then 'renderView' when 'click' then 'apply_click' when 'purchase' then 'SaveOrder' when 'signup' then 'create-user' else 'x' end name, event_id % 97 = 0 k from {events}) group by 1, 2"""),
    "archive_members": (archive_members, "select page_id, page_id % 5 > 1 safe, false safe_url, true repository, true sha from {pages}"),
}
