"""Purpose of files and symbols by weighted rules: signals as rows, summed, the best kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.functions.spread import spread
from codemass.functions.text import gram_tokens, mentions, normal_path, parent, phrase_hit, snippet, tokens
from codemass.schema import MACHINERY, PRODUCT, among

SNAP = "snapshot_id"
HEAD = 120_000

# Phrases of each category, in the order that breaks ties, and what a hit in the path weighs.
RULES = {
    "testing": ("test", "tests", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "assert", "pytest", "unittest", "xunit", "nunit", "jest", "vitest"),
    "meta-machinery": ("meta-audit", "audit auditor", "audit of audit", "validator validator", "verify verifier", "check checker", "report validator",
        "quality of audit", "audit quality", "compliance of compliance", "tooling analyzer"),
    "audit-provenance": ("audit", "auditor", "provenance", "receipt", "receipts", "evidence ledger", "reconcile", "reconciliation", "attestation",
        "traceability", "lineage record"),
    "verification": ("verify", "verification", "validate", "validation", "validator", "integrity", "checksum", "consistency", "invariant",
        "sanity check", "precondition", "postcondition", "assertion"),
    "observability": ("telemetry", "tracing", "trace", "metrics", "logging", "logger", "monitoring", "instrumentation", "diagnostic", "diagnostics",
        "span", "opentelemetry"),
    "process-machinery": ("workflow", "pipeline", "ci", "cd", "release", "packaging", "deploy", "deployment", "quality gate", "approval gate",
        "build orchestration"),
    "developer-tooling": ("tool", "tools", "generator", "scaffold", "scaffolding", "migration", "migrate", "bootstrap", "devtool", "codemod",
        "benchmark", "bench", "script", "scripts"),
    "user-surface": ("ui", "gui", "view", "views", "page", "pages", "screen", "dialog", "window", "controller", "route", "routes", "endpoint", "api",
        "cli", "command", "commands", "frontend", "component", "components", "interaction", "input", "menu"),
    "essential-support": ("storage", "database", "repository", "persistence", "serializer", "serialization", "network", "http", "adapter", "adapters",
        "cache", "filesystem", "file system", "transport", "protocol", "config", "configuration", "loader", "parser"),
    "core-product": ("gameplay", "game", "engine", "domain", "model", "models", "service", "services", "simulation", "render", "audio", "combat",
        "inventory", "session", "editor", "player", "business logic", "core"),
    "documentation": ("docs", "documentation", "readme", "guide", "manual", "tutorial", "architecture decision"),
}
PATH_WEIGHT = {
    "meta-machinery": 4.2, "audit-provenance": 3.8, "testing": 4.0, "process-machinery": 3.5, "observability": 3.3, "verification": 3.2,
    "user-surface": 2.9, "essential-support": 2.5, "developer-tooling": 2.8, "core-product": 2.1, "documentation": 4.5,
}
FOLDERS = (
    ("testing", ("tests", "test", "spec", "specs"), 5.0, "test/spec directory structure"),
    ("documentation", ("docs", "documentation"), 5.0, "documentation directory structure"),
    ("user-surface", ("ui", "gui", "frontend", "views", "pages", "screens", "controllers", "routes"), 5.0, "user-surface directory structure"),
    ("core-product", ("src", "app", "game", "domain", "features"), 1.2, "product-source directory structure"),
)
RECURSIVE_PHRASES = (
    "audit report", "validate report", "verify report", "validate receipt", "verify receipt", "audit validator", "validator result",
    "verification result", "telemetry validator", "reconcile audit", "audit reconciliation", "checker result", "validate evidence",
)


def _tokens_of(phrase: str) -> list[str]:
    return [t for t in phrase.lower().replace("_", " ").replace("-", " ").split() if t]


def _listed(tests: list[tuple[str, Column]]) -> Column:
    """The phrases whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(p)) for p, test in tests]))


#: Phrases of one word.  A text's words are cut once; only those that begin like a phrase are compared with phrases.
_SINGLE = sorted({p for phrases in RULES.values() for p in phrases if p.isalnum()})
_BEGINS = sorted({p[:4] for p in _SINGLE if len(p) >= 4})
_OTHERS = [p for phrases in RULES.values() for p in phrases if not p.isalnum()]


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _content_hits() -> Column:
    """All phrases that the text (column _c, its found words in _found) holds, in any order."""
    long = F.filter(_texts([p for p in _SINGLE if len(p) >= 4]), lambda p: F.exists("_found", lambda w: F.startswith(w, p)))
    short = F.array_intersect(_texts([p for p in _SINGLE if len(p) < 4]), F.col("_found"))
    return F.when(F.size("_found") > 0, F.concat(long, short)).otherwise(F.array().cast("array<string>"))


def _with_signals(files: DataFrame, head: int | None) -> DataFrame:
    """``files`` without text, with _s: every rule's signal (category, weight, reason, seq) in rule order.

    The text is cut into words once; hits are columns before anything is made of them, so that no
    test runs twice.  Only the first ``head`` characters are read, as the reference does; None reads all.
    """
    content = F.lower("text" if head is None else F.substring("text", 1, head))
    own = [c for c in files.columns if c not in ("text", "category", "confidence", "signals")]
    base = files.select(*own, content.alias("_c"), tokens("path").alias("_t"))
    words = F.array_distinct(F.split("_c", r"(?U)\W+"))
    base = base.withColumn("_found", F.filter(words, lambda w: F.substring(w, 1, 4).isin(_BEGINS) | w.isin([p for p in _SINGLE if len(p) < 4])))
    spelled = _listed([(p, F.size(F.array_except(_texts(_tokens_of(p)), "_t")) == 0) for p in _OTHERS])
    base = base.select("*", _content_hits().alias("_h1"), _listed([(p, phrase_hit("_c", p)) for p in _OTHERS]).alias("_h2"), spelled.alias("_h3"))
    inside, at_path = F.concat("_h1", "_h2"), F.concat("_t", "_h3")
    hits = {}
    for k, phrases in enumerate(RULES.values()):
        hits[f"_p{k}"] = F.array_intersect(_texts(phrases), at_path)
        hits[f"_i{k}"] = F.array_intersect(_texts(phrases), inside)
    hits["_deep"] = _listed([(p, F.contains("_c", F.lit(p))) for p in RECURSIVE_PHRASES])
    hits["_many"] = mentions("_c") >= 4
    found = base.select(*own, "_t", *[c.alias(k) for k, c in hits.items()])
    rows: list[tuple[str, Column, Column]] = [
        ("documentation", F.when(F.col("language").isin("markdown", "documentation"), F.lit(7.0)), F.lit("documentation file type")),
        ("process-machinery", F.when(F.col("path").startswith(".github/"), F.lit(8.0)), F.lit("GitHub workflow/process path")),
    ]
    for k, category in enumerate(RULES):
        at_path, inside = F.col(f"_p{k}"), F.col(f"_i{k}")
        weight = F.lit(PATH_WEIGHT[category]) + F.least(F.lit(2.0), F.lit(0.35) * (F.size(at_path) - 1))
        rows.append((category, F.when(F.size(at_path) > 0, weight), F.concat(F.lit("path signals: "), F.array_join(F.slice(at_path, 1, 4), ", "))))
        density = F.least(F.lit(3.6), F.lit(0.55) + F.log2(F.lit(1.0) + F.size(inside)))
        rows.append((category, F.when(F.size(inside) > 0, density), F.concat(F.lit("content signals: "), F.array_join(F.slice(inside, 1, 5), ", "))))
    for category, words, weight, reason in FOLDERS:
        rows.append((category, F.when(F.arrays_overlap("_t", F.array(*map(F.lit, words))), F.lit(weight)), F.lit(reason)))
    deep = F.col("_deep")
    weight = F.lit(4.5) + F.least(F.lit(2.5), F.size(deep) * 0.6)
    rows.append(("meta-machinery", F.when((F.size(deep) > 0) & F.col("_many"), weight),
            F.concat(F.lit("recursive machinery semantics: "), F.array_join(F.slice(deep, 1, 4), ", "))))
    made = F.array(*[F.struct(F.lit(c).alias("category"), w.cast("double").alias("weight"), r.alias("reason"), F.lit(k).alias("seq")) for k,
            (c, w, r) in enumerate(rows)])
    return found.select(*own, F.filter(made, lambda s: s["weight"].isNotNull()).alias("_s"))


def signals(files: DataFrame, *, head: int | None = HEAD) -> DataFrame:
    """(snapshot_id, path, category, weight, reason, seq): every rule's signal for each file, seq in rule order."""
    return _with_signals(files, head).select(SNAP, "path", F.explode("_s").alias("s")).select(SNAP, "path", "s.*")


def classify(files: DataFrame, overrides: DataFrame | None = None, *, keep_signals: int = 8, head: int | None = HEAD) -> DataFrame:
    """``files`` without text, with category, confidence and signals (the heaviest eight).

    The category of the best score holds; ties go to the category whose first signal comes first.  A file without any
    signal is unknown, at confidence 0.  ``overrides``: (prefix, category), see ``declared``.
    """
    def entry(category: Column) -> Column:
        own = F.filter("_s", lambda x: x["category"] == category)
        sum_ = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["weight"])
        score = F.when((category == "testing") & (sum_ >= 7), sum_ + 4.0).otherwise(sum_)
        return F.struct((-score).alias("o"), F.get(own, 0)["seq"].alias("first"), category.alias("category"), score.alias("score"), own.alias("w"))

    # all of it is local to a file: sums over its signals, no shuffle
    marked = _with_signals(files, head)
    categories = F.array_distinct(F.transform("_s", lambda x: x["category"]))
    ranked = marked.withColumn("r", F.array_sort(F.transform(categories, entry)))
    first = F.get("r", 0)
    best_score, second = first["score"], F.coalesce(F.get("r", 1)["score"], F.lit(0.0))
    sure = F.least(F.lit(0.99), F.lit(0.42) + F.lit(0.08) * best_score + F.lit(0.06) * F.greatest(F.lit(0.0), best_score - second))
    listed = F.flatten(F.transform("r", lambda e: F.transform(e["w"],
                lambda s: F.struct((-s["weight"]).alias("o"), s["seq"].alias("seq"), e["category"].alias("category"), s["weight"].alias("weight"),
                    s["reason"].alias("reason")))))
    kept = F.transform(F.slice(F.array_sort(listed), 1, keep_signals),
        lambda s: F.struct(s["category"].alias("category"), s["weight"].alias("weight"), s["reason"].alias("reason")))
    out = ranked.select(*marked.drop("_s").columns, first["category"].alias("_best"), F.when(F.size("r") > 0, sure).alias("_sure"), kept.alias("_signals"))
    declared_as = F.lit(None).cast("string")
    if overrides is not None:
        out = out.join(declared(files.select(SNAP, "path"), overrides), [SNAP, "path"], "left")
        declared_as = F.col("declared")
    one = F.array(F.struct(declared_as.alias("category"), F.lit(10.0).alias("weight"), F.lit("repository-declared path role").alias("reason")))
    none = F.array().cast("array<struct<category:string,weight:double,reason:string>>")
    out = out.withColumns({
        "category": F.coalesce(declared_as, "_best", F.lit("unknown")),
        "confidence": F.when(declared_as.isNotNull(), 1.0).otherwise(F.coalesce("_sure", F.lit(0.0))),
        "signals": F.when(declared_as.isNotNull(), one).otherwise(F.coalesce("_signals", none)),
    })
    return out.drop("_best", "_sure", "_signals", "declared")


def declared(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """(snapshot_id, path, declared): the category of the longest declared prefix; of equal ones the first.

    ``overrides``: prefix, category and optionally seq.  A path is cut into its leading folders and itself, which join
    the prefixes by equality.
    """
    rules = overrides if "seq" in overrides.columns else overrides.withColumn("seq", F.lit(0))
    rules = rules.select(normal_path("prefix").alias("prefix"), "category", "seq")
    parts = F.split(normal_path("path"), "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # each path's beginnings stay in its task, so that the groups below need no sort of all of them in one
    cut = spread(paths.select(SNAP, "path"), SNAP, "path").select(SNAP, "path", F.explode(begins).alias("prefix"))
    return cut.join(rules, "prefix").groupBy(SNAP, "path").agg(F.max_by("category", F.struct(F.length("prefix"), -F.col("seq"))).alias("declared"))


def ignored(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths`` without those under an ignored prefix."""
    hit = declared(paths.select(SNAP, "path"), prefixes.select("prefix", F.lit("x").alias("category")))
    return paths.join(hit.select(SNAP, "path"), [SNAP, "path"], "left_anti")


# Words of a symbol's own name and body, of telling paths, and of product folders.
ROLE_WORDS = {
    "meta-machinery": ("metaaudit", "auditofaudit", "auditquality", "reportvalidator"),
    "audit-provenance": ("audit", "auditor", "provenance", "reconcile", "reconciliation", "traceability", "lineage"),
    "verification": ("verify", "verified", "verification", "validate", "validation", "validator", "integrity", "checksum", "sha256", "invariant",
        "consistency"),
    "observability": ("telemetry", "trace", "tracing", "logging", "logger", "monitor", "monitoring", "diagnostic", "diagnostics", "opentelemetry"),
    "process-machinery": ("workflow", "deploy", "deployment", "packaging", "release"),
    "developer-tooling": ("probe", "benchmark", "bench", "scaffold", "generator", "codemod", "migration", "bootstrap"),
    "user-surface": ("gui", "view", "screen", "dialog", "window", "controller", "route", "endpoint", "cli", "command", "menu", "frontend"),
    "essential-support": ("config", "configuration", "storage", "store", "history", "cache", "serializer", "serialization", "parser", "loader",
        "filesystem", "transport", "protocol", "adapter", "catalog", "archive"),
}
PATH_ROLES = {
    "testing": ("test", "tests", "spec", "specs", "fixtures"),
    "audit-provenance": ("audit", "audits", "provenance"),
    "meta-machinery": ("metaaudit",),
    "observability": ("telemetry", "observability", "monitoring", "logging", "logger"),
    "verification": ("verification", "validators", "validation"),
    "process-machinery": ("workflow", "workflows", "ci", "cd", "deployment"),
    "developer-tooling": ("scripts", "tools", "benchmarks", "probes"),
    "user-surface": ("gui", "views", "screens", "controllers", "routes", "frontend"),
}
PRODUCT_FOLDERS = ("src", "source", "sources", "app", "apps", "service", "services", "protocol", "protocols", "feature", "features", "domain", "core", "sync")


def path_role(path: Column | str) -> Column:
    """The role that a path names by itself, by the first category that fits; null if none."""
    return _role_of(gram_tokens(path))


def _role_of(found: Column) -> Column:
    tests = [F.when(F.arrays_overlap(found, F.array(*map(F.lit, words))), F.lit(c)) for c, words in PATH_ROLES.items()]
    return F.coalesce(*tests)


def product_folder(path: Column | str) -> Column:
    """Whether the folder of a path names product source."""
    return F.arrays_overlap(gram_tokens(parent(path)), F.array(*map(F.lit, PRODUCT_FOLDERS)))


def local_scores(name_tokens: Column, body_tokens: Column) -> Column:
    """array<struct<category, score, rank>>: what a symbol's own words say, categories without a hit left out."""

    def one(k: int, category: str, words: tuple[str, ...]) -> Column:
        listed = F.array(*map(F.lit, words))
        named, inside = F.size(F.array_intersect(name_tokens, listed)), F.size(F.array_intersect(body_tokens, listed))
        by_name = F.when(named > 0, F.lit(5.0) + F.least(F.lit(2.0), F.lit(0.5) * (named - 1)) + (1.0 if category == "meta-machinery" else 0.0)).otherwise(0.0)
        by_body = F.when(inside > 0, F.least(F.lit(2.0), F.lit(0.35) * inside)).otherwise(0.0)
        return F.when((named > 0) | (inside > 0), F.struct(F.lit(category).alias("category"), (by_name + by_body).alias("score"), F.lit(k).alias("rank")))

    return F.array_compact(F.array(*[one(k, c, w) for k, (c, w) in enumerate(ROLE_WORDS.items())]))


def _settled(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with columns that are worked out once a row, whatever reads them: a generator's output is no expression to repeat."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("_one")
    return rows.select("*", one).select(*rows.columns, *[F.col(f"_one.{k}").alias(k) for k in made])


def refine_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbols`` with category, role_confidence and role_source refined.

    A path that names a role settles all its symbols.  Product and support stay, unless a symbol's own words clearly
    name another purpose that is no machinery.  Machinery stays only where a symbol's own words clearly say so; else it
    is product under a product folder and support elsewhere.  ``files``: snapshot_id, path, lines_of (array<string>).
    """
    # symbols are spread over tasks before they meet their files' lines, which are left out of that shuffle
    joined = spread(symbols).join(files.select(SNAP, "path", F.col("lines_of").alias("_lines")), [SNAP, "path"], "left")
    lines = F.coalesce("_lines", F.array().cast("array<string>"))
    # names and bodies are cut into tokens once
    joined = _settled(joined, _named=F.array_union(gram_tokens("name"), gram_tokens("qualified_name")),
        _body=gram_tokens(snippet(lines, F.col("start_line"), F.col("end_line"))), _at=gram_tokens("path"), _above=gram_tokens(parent("path"))).drop("_lines")
    joined = _settled(joined, _scores=local_scores(F.col("_named"), F.col("_body")), _path=_role_of(F.col("_at")),
        _product=F.arrays_overlap("_above", F.array(*map(F.lit, PRODUCT_FOLDERS)))).drop("_named", "_body", "_at", "_above")
    ranked = F.array_sort(F.transform("_scores",
            lambda s: F.struct((-s["score"]).alias("o"), s["rank"].alias("rank"), s["category"].alias("category"), s["score"].alias("score"))))
    joined = _settled(joined, _r=ranked).drop("_scores").withColumns(
        {"_best": F.try_element_at("_r", F.lit(1)), "_next": F.coalesce(F.try_element_at("_r", F.lit(2))["score"], F.lit(0.0))})
    best, score = F.col("_best.category"), F.col("_best.score")
    clear = F.coalesce((score >= 5.0) & (score - F.col("_next") >= 0.5), F.lit(False))
    machine = among("category", MACHINERY)
    own_product = ~machine & clear & ~among(best, MACHINERY)
    own_machine = machine & clear & among(best, MACHINERY)
    fallback = F.when(F.col("_product"), "core-product").otherwise("essential-support")
    is_file, by_path = F.col("kind") == "file", F.col("_path").isNotNull()

    def choose(file, path, own_p, keep, own_m, fall) -> Column:
        return F.when(is_file, file).when(by_path, path).when(own_product, own_p).when(~machine, keep).when(own_machine, own_m).otherwise(fall)

    category = choose(F.col("category"), F.col("_path"), best, F.col("category"), best, fallback)
    sure = choose(
        F.lit(1.0), F.lit(0.98), F.least(F.lit(0.95), F.lit(0.66) + F.lit(0.04) * score), F.when(among("category", PRODUCT), 0.72).otherwise(0.62),
        F.least(F.lit(0.97), F.lit(0.68) + F.lit(0.04) * score), F.when(fallback == "core-product", 0.68).otherwise(0.62),
    )
    source = choose(*map(F.lit, ("file-classification", "strong-path-role", "symbol-local-product-evidence", "file-seed-preserved",
                "symbol-local-machinery-evidence", "mixed-file-context-fallback")))
    made = joined.select(*[c for c in symbols.columns if c not in ("category", "role_confidence", "role_source")], category.alias("category"),
        sure.alias("role_confidence"), source.alias("role_source"))
    return made
