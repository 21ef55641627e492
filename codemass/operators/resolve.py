"""Resolution of imports to files and of relationship names to symbols, as hash joins on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codemass.functions.checkpoint import checkpointed
from codemass.functions.spread import spread
from codemass.functions.text import col, import_targets, module_aliases, normal_module, normal_path, normal_target, parent, tail

SNAP = "snapshot_id"
#: Entries of a relation that may be handed to all tasks.
_HELD = 400_000


def _candidates(path: Column | str, raw: Column | str) -> Column:
    r = col(raw)
    dotted = F.replace(parent(path), F.lit("/"), F.lit("."))
    dotted = F.when(dotted == "", ".").otherwise(dotted)
    relative = F.when(r.startswith("."), F.regexp_replace(F.concat(dotted, F.lit("."), F.regexp_replace(r, r"^\.+", "")), r"^\.+|\.+$", ""))
    named = F.array_compact(F.array(r, F.replace(r, F.lit("::"), F.lit(".")), F.replace(r, F.lit("/"), F.lit(".")), relative))
    slashed = F.transform(named, normal_path)
    return F.array_distinct(F.concat(slashed, F.transform(slashed, lambda c: F.replace(c, F.lit("/"), F.lit(".")))))


def file_dependencies(files: DataFrame) -> DataFrame:
    """(snapshot_id, src, dst): imports joined with the names that files go by, never a file with itself.

    An import that no name fits falls back to its last part, if that is three characters or more and the last part
    of one file's names only.
    """
    names = files.select(SNAP, "path", F.explode(module_aliases("path")).alias("alias"))
    alias = names.select(SNAP, F.explode(F.array("alias", F.replace("alias", F.lit("/"), F.lit(".")))).alias("alias"), F.col("path").alias("dst")).distinct()
    wants = files.select(SNAP, F.col("path").alias("src"), F.explode(F.array_distinct("imports")).alias("raw"))
    wants = wants.withColumn("_c", _candidates("src", "raw"))
    hits = wants.select(SNAP, "src", "raw", F.explode("_c").alias("alias")).join(alias, [SNAP, "alias"]).select(SNAP, "src", "raw", "dst").distinct()
    missing = wants.join(hits.select(SNAP, "src", "raw").distinct(), [SNAP, "src", "raw"], "left_anti")
    single = names.withColumn("tail", tail("alias")).where(F.length("tail") >= 3).groupBy(SNAP, "tail").agg(F.countDistinct("path").alias("_n"),
        F.min("path").alias("dst")).where("_n = 1").drop("_n")
    tails = missing.select(SNAP, "src", F.explode(F.array_distinct(F.transform("_c", tail))).alias("tail")).where(F.length("tail") >= 3)
    return hits.select(SNAP, "src", "dst").union(tails.join(single, [SNAP, "tail"]).select(SNAP, "src", "dst")).where("src <> dst").distinct()


def resolve_imports(edges: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(snapshot_id, edge_seq, target_id, resolution) of import edges that a dependency of their file answers.

    One matching file makes it exact, several make the first by path probable.  Edges without a match are left out.
    """
    source = symbols.select(SNAP, F.col("id").alias("source_id"), F.col("path").alias("src"))
    wants = edges.where("kind = 'imports' and target_id is null").join(source, [SNAP, "source_id"])
    wants = wants.select(SNAP, "edge_seq", "src", import_targets("target_name").alias("_t"))
    deps = dependencies.select(SNAP, "src", "dst").withColumn("_a", F.array_distinct(F.transform(module_aliases("dst"), normal_module)))

    def fits(t: Column) -> Column:
        return F.exists("_a", lambda a: (t == a) | F.startswith(t, F.concat(a, F.lit("."))) | F.startswith(a, F.concat(t, F.lit("."))))

    files = symbols.where("kind = 'file'").select(SNAP, F.col("path").alias("dst"), "id")
    found = wants.join(deps, [SNAP, "src"]).where(F.exists("_t", fits)).join(files, [SNAP, "dst"])
    picked = found.groupBy(SNAP, "edge_seq").agg(F.count("*").alias("_n"), F.min(F.struct("dst", "id")).alias("_f"))
    return picked.select(SNAP, "edge_seq", F.col("_f.id").alias("target_id"), F.when(F.col("_n") == 1, "exact").otherwise("probable").alias("resolution"))


def _counted(rows: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """For each key: how many symbols, and the first by path, line and name."""
    return rows.groupBy(SNAP, "target", *keys).agg(F.sum(n).alias("_n"), F.min("_f").alias("_f"))


def _held(rows: DataFrame, entries: Column) -> DataFrame:
    """``rows``, which hold few entries each: small ones are handed to all tasks, others are left to a shuffle."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.agg(F.sum(1 + entries)).first()[0] in range(_HELD + 1) else rows


def _answers(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What symbols answer to names: by (name, path) and by name.  Candidates are counted before any edge is joined.

    A name in a path has ``_own``, the one symbol of a bare name there, and ``_of``, the one symbol by language of a dotted name and by
    parent of a bare one; a name has ``_by``, the first symbol by language and whether it is the only one of a dotted name, and ``_any``, the first.
    """
    inner = spread(symbols.where("kind <> 'file'").select(SNAP, "id", "path", "language", "name", "qualified_name", "start_line", "parent_id"))
    refs = F.concat(F.array("qualified_name", "name"),
        F.transform(module_aliases("path"), lambda m: F.regexp_replace(F.concat(m, F.lit("."), F.col("qualified_name")), r"^\.+|\.+$", "")))
    dotted = F.col("target").contains(".")
    by_ref = inner.withColumn("target", F.explode(F.array_distinct(F.transform(F.filter(refs, lambda r: r != ""), normal_target)))).where(dotted).distinct()
    by_name = inner.withColumn("target", F.explode(F.array_distinct(F.array("name", "qualified_name")))).where(~dotted & (F.col("target") != ""))
    every = by_ref.union(by_name).select(SNAP, "target", "path", "language", F.coalesce("parent_id", F.lit("\x00")).alias("parent_id"),
        F.struct("path", "start_line", "qualified_name", "id").alias("_f"))
    every = checkpointed(_counted(every, ["path", "language", "parent_id"], F.lit(1)))
    n, first, one = F.col("_n"), F.col("_f.id"), F.col("_n") == 1
    entries = lambda test, key, value: F.map_from_entries(F.collect_list(F.when(test & F.col(key).isNotNull(), F.struct(key, value))))
    of = every.withColumn("_key", F.when(dotted, F.col("language")).otherwise(F.col("parent_id")))
    here = _counted(of, ["path", "_key"], n).groupBy(SNAP, "target", "path").agg(entries(one, "_key", first).alias("_of"), F.sum("_n").alias("_n"), F.min("_f").alias("_f"))
    here = here.select(SNAP, "target", "path", F.when(~dotted & one, first).alias("_own"), "_of").where("_own is not null or size(_of) > 0")
    known = F.struct(first.alias("id"), (dotted & one).alias("exact"))
    there = _counted(every, ["language"], n).groupBy(SNAP, "target").agg(entries(F.lit(True), "language", known).alias("_by"), F.min("_f").alias("_f"))
    return _held(here, F.size("_of")), _held(there.select(SNAP, "target", "_by", first.alias("_any")), F.size("_by"))


def resolve_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(snapshot_id, edge_seq, target_id, resolution) of every edge that has no target and is not ``contains``.

    Dotted names: one symbol of that reference in the file is exact, else one of the language is exact, else the first of
    the language, or of all, is probable.  Bare names: one within the same parent is exact, else one in the file; one or
    more of the language, or of any, make the first probable.  Names that nothing answers are unresolved.  Edges are read once
    and meet their sources, then what their names mean in a path, then what they mean anywhere.
    """
    here, there = _answers(symbols)
    source = spread(symbols.select(SNAP, F.col("id").alias("source_id"), F.col("path").alias("path"), "language", "parent_id"), SNAP, "source_id")
    wants = edges.where("target_id is null and kind <> 'contains'").join(source, [SNAP, "source_id"]).select(SNAP, "edge_seq", "path", "language",
        "parent_id", normal_target("target_name").alias("target")).where("target is not null")
    met = wants.join(here, [SNAP, "target", "path"], "left").join(there, [SNAP, "target"], "left")
    answer = lambda found, how: F.when(found.isNotNull(), F.struct(found.alias("id"), how.alias("resolution")))
    exact, probable = F.lit("exact"), F.lit("probable")
    key = F.when(F.col("target").contains("."), F.col("language")).otherwise(F.coalesce("parent_id", F.lit("\x00")))
    tongue = F.try_element_at("_by", F.col("language"))
    tiers = [answer(F.try_element_at("_of", key), exact), answer(F.col("_own"), exact), answer(tongue["id"], F.when(tongue["exact"], exact).otherwise(probable)),
        answer(F.col("_any"), probable)]
    return met.select(SNAP, "edge_seq", F.coalesce(*tiers).alias("_r")).select(SNAP, "edge_seq", F.col("_r.id").alias("target_id"),
        F.coalesce("_r.resolution", F.lit("unresolved")).alias("resolution"))


def resolve_relationships(edges: DataFrame, symbols: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """``edges`` with target_id and resolution filled: imports by file dependencies first, all others by name."""
    by_name = resolve_names(edges, symbols)
    if dependencies is not None:
        by_file = resolve_imports(edges, symbols, dependencies)
        by_name = by_file.union(by_name.join(by_file.select(SNAP, "edge_seq"), [SNAP, "edge_seq"], "left_anti"))
    new = by_name.select(SNAP, "edge_seq", F.col("target_id").alias("_t"), F.col("resolution").alias("_r"))
    out = edges.join(new, [SNAP, "edge_seq"], "left")
    return out.withColumns({"target_id": F.coalesce("target_id", "_t"), "resolution": F.coalesce("_r", "resolution")}).drop("_t", "_r").select(*edges.columns)
