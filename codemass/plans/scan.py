"""Composite plans: whole scans of trees and of series of commits, each one set of relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.functions import scalars
from codemass.functions.checkpoint import checkpointed
from codemass.operators import classify, compare, corpus, journeys, layout, metabolism, metrics, references, resolve, select, surfaces, traverse
from codemass.sources import parse, records, trees

SNAP = "snapshot_id"


@dataclass
class Scan:
    """The relations of one or many scanned trees."""

    files: DataFrame
    components: DataFrame
    dependencies: DataFrame
    metrics: DataFrame
    profiles: DataFrame
    chains: DataFrame
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    diagnostics: DataFrame | None = None
    symbol_chains: DataFrame | None = None
    symbol_metrics: DataFrame | None = None
    contents: Contents | None = None


@dataclass
class Contents:
    """Each different content of a path once, keyed by it in the place of a snapshot, and where it stands."""

    files: DataFrame
    classified: DataFrame
    placed: DataFrame | None = None

    def each(self, df: DataFrame) -> DataFrame:
        """``df`` of contents as rows of the snapshots that hold them."""
        if self.placed is None:
            return df
        named = df.withColumnRenamed(SNAP, "_content")
        return self.placed.join(named, ["path", "_content"]).select(*df.columns)


def scan(raw: DataFrame, *, overrides: DataFrame | None = None, ignore: DataFrame | None = None, symbols: bool = True, placed: DataFrame | None = None) -> Scan:
    """All relations of raw trees (snapshot_id, path, content).

    Without ``symbols`` only the file half is made.  Texts are read and counted once and cut from their lineage.  With ``placed``
    (snapshot_id, path, _content) the raw rows are contents, named in their snapshot_id, and what is local to a file (lines, category,
    symbols) is worked out once for each; what follows from a whole tree is worked out for each snapshot.
    """
    files = trees.files(raw)
    if ignore is not None:
        files = classify.ignored(files, ignore)
    files = checkpointed(parse.with_python_lines(files))
    classified = classify.classify(files.drop("lines_of"), overrides)
    contents = Contents(files, classified if placed is None else checkpointed(classified), placed)
    components = checkpointed(contents.each(contents.classified))
    dependencies = checkpointed(resolve.file_dependencies(components))
    components = checkpointed(traverse.value_distances(components, dependencies))
    chains, _ = traverse.audit_chains(components, dependencies)
    depths = chains.groupBy(SNAP).agg(F.max("depth").alias("max_depth"))
    out = Scan(contents.each(files), components, dependencies, metrics.composition(components, depths), metrics.directory_profiles(components), chains)
    out.contents = contents if placed is not None else None
    return with_symbols(out) if symbols else out


def with_symbols(s: Scan) -> Scan:
    """A scan with its symbols refined, relationships resolved, distances, chains and metrics."""
    own = s.contents or Contents(s.files, s.components)
    rows = checkpointed(parse.parsed(own.files))
    found = classify.refine_symbols(parse.symbols(rows, own.classified), own.files.select(SNAP, "path", "lines_of"))
    found = checkpointed(own.each(found))
    s.edges = checkpointed(resolve.resolve_relationships(parse.edges(own.each(rows.where("row = 'edge'"))), found, s.dependencies))
    s.symbols = checkpointed(traverse.symbol_distances(found, s.edges))
    s.symbol_chains, spent = traverse.recursive_chains(s.symbols, s.edges)
    note = spent.where("truncated").select(SNAP, F.lit("<semantic-graph>").alias("path"), F.lit("graph").alias("language"),
        F.lit("Recursive chain traversal reached its budget; depth may be understated.").alias("message"), F.lit("warning").alias("severity"))
    s.diagnostics = own.each(parse.diagnostics(rows)).unionByName(note)
    s.symbol_metrics = metrics.symbol_metrics(s.symbols, s.edges, s.symbol_chains.groupBy(SNAP).agg(F.max("depth").alias("max_depth")))
    return s


def scan_folder(spark: SparkSession, path: str, *, snapshot: str = "tree", **options) -> Scan:
    """A scan of a folder that all executors can reach."""
    trees.register(spark)
    return scan(spark.read.format("source_tree").option("path", path).option("snapshot", snapshot).load(), **options)


def scan_commits(spark: SparkSession, path: str, commits: DataFrame, **options) -> Scan:
    """One scan of all given commits (frame, sha), oldest first: each is a snapshot.

    The commits' differences tell which contents of a path stand in which of them; each content is read, classified and parsed
    once.  Trees whose attributes keep files from archives or change them there are read as archives, whole.
    """
    trees.register(spark)
    shas = [r["sha"] for r in commits.select("frame", "sha").orderBy("frame").collect()]  # at most 200
    runs = checkpointed(trees.commit_runs(spark, path, shas))
    attributes = runs.where(F.element_at(F.split("path", "/"), -1) == ".gitattributes")
    if not trees.blobs(path, attributes).where(F.contains(F.col("content"), F.lit(b"export-"))).isEmpty():
        return scan(spark.read.format("git_tree").option("path", path).option("commits", ",".join(shas)).load(), **options)
    names = spark.createDataFrame(list(enumerate(shas)), f"_frame int, {SNAP} string")
    placed = runs.select("path", F.col("blob").alias("_content"), F.explode(F.sequence("first", "last")).alias("_frame")).join(F.broadcast(names), "_frame")
    kept = runs.join(attributes.select("path").distinct(), "path", "left_anti")
    return scan(trees.blobs(path, kept), placed=checkpointed(placed.drop("_frame")), **options)


def history(s: Scan, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints of each commit, and events between neighbouring ones."""
    frames = commits.select(F.col("sha").alias(SNAP), "frame", F.lit("repo").alias("repository"))
    points = frames.join(s.metrics, SNAP).join(s.symbol_metrics, SNAP, "left").select(
        "repository", "frame", F.col(SNAP).alias("sha"), F.col("direct_product_share").alias("product_share"),
        F.col("tooling_share").alias("machinery_share"), "scaffolding_ratio",
        F.coalesce("max_recursive_depth", F.lit(0)).alias("recursive_depth"), "semantic_recursion_index", "exact_coverage",
    )
    folders = frames.join(s.profiles, SNAP).select("repository", "frame", "path", "product_lines", "machinery_lines", "is_inversion")
    inverted = folders.groupBy("repository", "frame").agg(F.sum(F.col("is_inversion").cast("long")).alias("inversion_count"))
    return points.join(inverted, ["repository", "frame"], "left").fillna(0, ["inversion_count"]), compare.history_events(points, folders)


def movie(s: Scan, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layout of each commit, and the changes of each against the one before; the first has none."""
    frames = commits.select(F.col("sha").alias(SNAP), "frame")
    rects = layout.treemap(s.components).join(frames, SNAP)
    flat = frames.join(s.components, SNAP).where("code_lines > 0").select("frame", "path", F.col("code_lines").alias("weight"), "category", "value_distance")
    before = flat.withColumn("frame", F.col("frame") + 1).join(frames.select("frame"), "frame", "left_semi")
    return rects, compare.layout_changes(before, flat.where("frame > 0"), ("frame",))


def use_evidence(s: Scan, *, name_boundaries: bool = True) -> DataFrame:
    """(snapshot_id, path, kind, source, detail): all six kinds of evidence that a file is in use; with ``name_boundaries`` the trusted
    boundary behind each reference that was passed on, too."""
    text = s.files.select(SNAP, "path", "text").join(s.components.select(SNAP, "path", "category"), [SNAP, "path"])
    found = checkpointed(atlas(s))
    reached = surfaces.implementation(found, s.symbols, s.edges)
    rows = metabolism.structural_use(s.symbols, s.edges, s.dependencies).unionByName(metabolism.capability_use(found, s.symbols, reached)).unionByName(
        references.use(text, name_boundaries=name_boundaries), allowMissingColumns=True)
    return rows.join(s.components.select(SNAP, "path"), [SNAP, "path"], "left_semi")


def metabolise(s: Scan, commits: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The status of every file of the last commit: a file is active where any of the six kinds of evidence holds."""
    frames = commits.select(F.col("sha").alias(SNAP), "frame")
    used = (use_evidence(s, name_boundaries=False) if evidence is None else evidence).select(SNAP, "path").distinct().withColumn("active", F.lit(True))
    # a file changes where its size, lines, category or text does
    own = s.contents or Contents(s.files, s.components)
    prints = own.each(own.files.select(SNAP, "path", F.col("bytes").cast("string").alias("_bytes"), F.sha2("text", 256).alias("_sha")))
    kinds = s.components.select(SNAP, "path", F.col("category").alias("_category"), F.col("code_lines").cast("string").alias("_lines"))
    prints = prints.join(kinds, [SNAP, "path"]).select(SNAP, "path", F.concat_ws(":", "_bytes", "_lines", "_category", "_sha").alias("print"))
    rows = prints.join(s.components.select(SNAP, "path", "category", "code_lines"), [SNAP, "path"]).join(used, [SNAP, "path"], "left").fillna(False, ["active"])
    return metabolism.status(rows.join(frames, SNAP).select(F.lit("repo").alias("repository"), "frame", "path", "category", "code_lines", "active", "print"))


def atlas(s: Scan, *, top_level: str = "no_parent") -> DataFrame:
    """Externally visible surfaces with their evidence and anchors."""
    placed = surfaces.routes(s.files).unionByName(surfaces.exports(s.files)).unionByName(surfaces.package_bins(s.files)).unionByName(
        parse.python_exports(s.files))
    scripts = surfaces.packaged_scripts(s.files)
    near = surfaces.nearest_symbol(placed.withColumn("_shown", F.col("name")).withColumn("name",
            F.when(F.col("kind") == "public-api", F.col("name"))), s.symbols)
    near = near.withColumn("name", F.col("_shown")).drop("_shown")
    named = surfaces.module_symbol(scripts, s.symbols).drop("module", "callable")
    both = near.unionByName(named).unionByName(surfaces.entry_points(s.files, s.symbols))
    both = checkpointed(both.where("evidence_kind <> 'python-export' or symbol_id is not null"))
    more = surfaces.declared_surfaces(s.files, s.symbols, both.where("symbol_id is not null"), top_level=top_level)
    return surfaces.merge_capabilities(both.unionByName(more).withColumn("seq", F.xxhash64("path", "line", "evidence_kind", "detail")))


def atlas_reach(s: Scan, capabilities: DataFrame) -> DataFrame:
    """``capabilities`` with the files and symbols that implement each."""
    return surfaces.with_implementation(capabilities, checkpointed(surfaces.implementation(capabilities, s.symbols, s.edges)), s.edges)


def value_path(s: Scan, capabilities: DataFrame, selector: str | None, *, max_depth: int = 12) -> DataFrame:
    """The strongest call path of the selected capability, and up to five others: a row for each path."""
    return _value_path(s, capabilities, selector, max_depth)[0]


def value_path_steps(s: Scan, capabilities: DataFrame, selector: str | None, *, max_depth: int = 12) -> DataFrame:
    """The same paths with a row for each symbol on them and the call that led to it."""
    return traverse.path_steps(*_value_path(s, capabilities, selector, max_depth))


def _value_path(s: Scan, capabilities: DataFrame, selector: str | None, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    chosen = select.capability(capabilities, selector)
    calls = traverse.exact_edges(s.edges).where("kind = 'calls'")
    roots = chosen.where("symbol_id is not null").select(SNAP, F.col("symbol_id").alias("node"))
    return traverse.strongest_paths(calls, roots, s.symbols, max_depth=max_depth), s.symbols, calls


def data_journey(s: Scan, selector: str | None) -> dict[str, DataFrame]:
    """Events, stages, boundaries, warnings and the number of calls looked at, of the selected data type."""
    types = select.data_symbol(s.symbols, selector).select(SNAP, F.col("id").alias("type_id"))
    found = checkpointed(surfaces.journeys(types, s.symbols, s.edges))
    return {
        "events": journeys.events(found, s.symbols), "stages": surfaces.journey_stages(found, types),
        "boundaries": journeys.boundaries(types, s.symbols, s.edges), "examined": journeys.examined(types, s.edges),
        "warnings": surfaces.journey_warnings(found, types, s.symbols, s.edges),
    }


def record(s: Scan, names: DataFrame, *, version: str, revision: str) -> DataFrame:
    """One corpus record for each snapshot: names has snapshot_id, repository, sha, scanned_at."""
    code = metrics.category_lines(s.components).groupBy(SNAP).agg(
        F.map_from_entries(F.collect_list(F.struct("category", F.col("code_lines").cast("double")))).alias("lines"))
    roles = s.symbols.groupBy(SNAP, "category").agg(F.count("*").cast("double").alias("n")).groupBy(SNAP).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("roles"))
    rows = names.join(s.metrics, SNAP).join(s.symbol_metrics, SNAP, "left").join(code, SNAP, "left").join(roles, SNAP, "left")
    value = lambda c: F.col(c).cast("double")
    return rows.select(
        F.lit("ok").alias("status"), "scanned_at", scalars.identity_key("repository", "sha", F.lit(version), F.lit(revision)).alias("identity"),
        F.struct(F.col("repository").alias("name"), F.col("sha"), F.lit(None).cast("string").alias("id")).alias("repository"),
        F.struct(F.lit("codemass").alias("name"), F.lit(version).alias("version"), F.lit(revision).alias("source_revision"),
            F.lit(True).alias("canonical")).alias("analyzer"),
        F.struct(
            F.lit("semantic-v1").alias("measurement_model"), F.col("lines").alias("category_code_lines"), F.col("roles").alias("category_symbol_counts"),
            F.struct(value("direct_product_share").alias("direct_product_share"), value("tooling_share").alias("tooling_share"),
                value("scaffolding_ratio").alias("scaffolding_ratio")).alias("baseline"),
            F.struct(
                value("relationship_count").alias("relationship_count"), value("exact_resolution_rate").alias("exact_resolution_rate"),
                value("max_recursive_depth").alias("max_recursive_depth"),
                value("semantic_recursion_index").alias("semantic_recursion_index"), value("far_from_value_symbol_share").alias("far_from_value_symbol_share"),
            ).alias("semantic"),
        ).alias("measurement"),
        F.lit(None).cast("struct<code:string,message:string>").alias("reason"),
    )


def index(spark: SparkSession, targets: DataFrame, corpus_path: str, *, version: str, revision: str, refresh: bool = False) -> DataFrame:
    """Scans the tarballs of targets that the corpus lacks in one job, and appends their records.

    ``targets``: repository, sha, path (a tarball that all executors can reach).  At most 100 targets a call.  A tarball
    that fails closed becomes a failed record with its reason and does not stop the others.
    """
    trees.register(spark)
    named = targets.withColumn("identity", scalars.identity_key("repository", "sha", F.lit(version), F.lit(revision)))
    if not refresh and records.exists(spark, corpus_path):
        named = corpus.skip_known(named, records.corpus(spark, corpus_path))
    few = named.limit(101).collect()
    if len(few) > 100:
        raise ValueError("at most 100 targets a call")
    # the executors check the tarballs, few to a task
    rows = trees.checked(spark.createDataFrame(few, named.schema).repartition(max(1, len(few)), "path")).collect()
    good = [r for r in rows if r["code"] is None]
    bad = [(r, r["code"], r["message"]) for r in rows if r["code"] is not None]
    made = spark.createDataFrame([], records.RECORD)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if good:
        s = scan(spark.read.format("source_tarball").option("path", ",".join(r["path"] for r in good)).load())
        names = spark.createDataFrame([(r["path"].rsplit("/", 1)[-1], r["repository"], r["sha"]) for r in good],
            "snapshot_id string, repository string, sha string")
        made = made.unionByName(record(s, names.withColumn("scanned_at", now), version=version, revision=revision))
    if bad:
        failed = spark.createDataFrame([(r["identity"], r["repository"], r["sha"], code, message) for r, code, message in bad],
            "identity string, name string, sha string, code string, message string")
        made = made.unionByName(failed.select(F.lit("failed").alias("status"), now.alias("scanned_at"), "identity",
                F.struct("name", "sha", F.lit(None).cast("string").alias("id")).alias("repository"), F.struct("code", "message").alias("reason")),
                allowMissingColumns=True)
    made = checkpointed(made)
    records.append(made, corpus_path)
    return made
