"""Saved results: folders of JSON lines, a section each, that name their schema and commit, and plans over saved scans.

A section is written by the executors, whatever its size; only the one row of the head is read on the driver.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.functions.checkpoint import checkpointed
from codemass.operators import compare, metrics
from codemass.plans import explore, scan
from codemass.plans.scan import SNAP, Scan

VERSION = 1


class ArtifactError(ValueError):
    """A saved result that cannot be used, and why."""


def save(spark: SparkSession, folder: str, name: str, sha: str | None, sections: dict[str, DataFrame]) -> None:
    """Writes a new artifact; a folder that exists fails.  Numbers that are not finite fail as well."""
    for section, df in sections.items():
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        for c in numbers:
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{section}.{c} is not finite")).cast("double")).otherwise(F.col(c)))
        df.write.json(f"{folder}/{section}")
    head = {"schema": {"name": f"codemass-{name}", "version": VERSION}, "repository_sha": sha, "sections": sorted(sections),
        "columns": {k: df.schema.json() for k, df in sections.items()}}
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/head")


def head(spark: SparkSession, folder: str, name: str) -> dict:
    """The head of an artifact that has to be of the named schema."""
    try:
        lines = [r["value"] for r in spark.read.text(f"{folder}/head").limit(2).collect()]
        found = json.loads(lines[0]) if len(lines) == 1 else None
    except json.JSONDecodeError as e:
        raise ArtifactError(f"{folder} is no valid JSON: {e}") from e
    except Exception as e:
        raise ArtifactError(f"could not read {folder}: {str(e).splitlines()[0]}") from e
    if not isinstance(found, dict):
        raise ArtifactError(f"{folder} has to hold one JSON object")
    schema = found.get("schema")
    seen = schema.get("name") if isinstance(schema, dict) else schema.split("/", 1)[0] if isinstance(schema, str) else None
    if seen != f"codemass-{name}":
        raise ArtifactError(f"{folder} has schema {seen or 'missing'!r}; expected 'codemass-{name}'")
    sha = found.get("repository_sha")
    if sha is not None and not re.fullmatch("[0-9a-f]{40}", str(sha)):
        raise ArtifactError(f"{folder} names no full commit hash")
    return found


def section(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A section of an artifact; one that was empty has no rows."""
    return spark.read.schema(schema).json(f"{folder}/{name}")


def saved(spark: SparkSession, folder: str, told: dict, name: str) -> DataFrame:
    """A section as it was saved, by the columns that the artifact's head names; they hold for empty ones too."""
    columns = (told.get("columns") or {}).get(name)
    return (spark.read.schema(T.StructType.fromJson(json.loads(columns))) if columns else spark.read).json(f"{folder}/{name}")


SCAN = {
    "metrics": "direct_product_share double, tooling_share double, scaffolding_ratio double, total_lines long",
    "category_lines": "category string, code_lines long",
    "profiles": "path string, product_lines long, machinery_lines long, code_lines long, scaffolding_ratio double, is_inversion boolean",
    "components": "path string, category string, code_lines long, value_distance int", "chains": "symbol_ids array<string>, depth int",
    "symbol_metrics": "relationship_count long, max_recursive_depth int, semantic_recursion_index double, exact_coverage double",
    "identity": "version string, source string, canonical boolean, sha string",
}


def of_scan(s: Scan, *, snapshot: str | None = None, version: str, source: str, canonical: bool, sha: str | None) -> dict[str, DataFrame]:
    """The sections of one snapshot's scan."""
    one = (lambda df: df.where(F.col(SNAP) == snapshot).drop(SNAP)) if snapshot else (lambda df: df.drop(SNAP))
    spark = s.components.sparkSession
    lines = metrics.category_lines(s.components).select(SNAP, "category", "code_lines")
    return {
        "metrics": one(s.metrics), "category_lines": one(lines), "profiles": one(s.profiles),
        "components": one(s.components.select(SNAP, *[c.split()[0] for c in SCAN["components"].split(", ")])),
        "chains": one(s.symbol_chains.select(SNAP, "symbol_ids", "depth")), "symbol_metrics": one(s.symbol_metrics),
        "identity": spark.createDataFrame([(version, source, canonical, sha)], SCAN["identity"]),
    }


def read_scan(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sections of a saved scan."""
    head(spark, folder, "scan")
    return {k: section(spark, folder, k, schema) for k, schema in SCAN.items()}


def comparison(before: dict[str, DataFrame], after: dict[str, DataFrame], *, keep: int = 8) -> dict[str, DataFrame]:
    """What changed between two scans: identity, metrics, categories, files, folders, chains, and all of it in words."""
    deltas = compare.category_deltas(before["category_lines"], after["category_lines"])
    crossed = compare.crossovers(before["profiles"], after["profiles"])
    chains = checkpointed(compare.chain_changes(compare.deepest_chains(before["chains"]), compare.deepest_chains(after["chains"])))
    both = lambda name: before[name].select(F.struct("*").alias("before")).join(after[name].select(F.struct("*").alias("after")), F.lit(True))
    depth = both("symbol_metrics").select(F.col("before.max_recursive_depth").alias("before"), F.col("after.max_recursive_depth").alias("after"))
    return {
        "identity": both("identity").select(*[v.alias(k) for k, v in compare.identity_flags().items()]),
        "metrics": both("metrics").join(both("symbol_metrics").select(F.col("before").alias("symbols_before"), F.col("after").alias("symbols_after")),
            F.lit(True)),
        "categories": deltas, "files": compare.change_drivers(before["components"], after["components"], keep=keep),
        "inversions": compare.inversion_changes(before["profiles"], after["profiles"]),
        "crossovers": crossed, "chains": chains, "explanations": compare.structural_explanations(deltas, crossed, depth, chains),
    }


def drivers(s: Scan, before_sha: str, after_sha: str, *, keep: int = 8, **identity) -> dict[str, DataFrame]:
    """The comparison of two commits that were scanned together."""
    sides = [of_scan(s, snapshot=sha, sha=sha, canonical=True, **identity) for sha in (before_sha, after_sha)]
    return comparison(*sides, keep=keep)


def story(spark: SparkSession, scan_folder: str, *, history: str | None = None, drivers: str | None = None, context: str | None = None) -> dict[str, DataFrame]:
    """A saved scan beside other saved results: whether each is of the scan's commit, and its rows as they were saved."""
    own = head(spark, scan_folder, "scan")
    shas, out = {}, {}
    for name, folder, column in (("comparison", history, "after_sha"), ("drivers", drivers, "after_sha"), ("context", context, "sha")):
        told = head(spark, folder, {"comparison": "history", "drivers": "drivers", "context": "context"}[name]) if folder else None
        shas[name] = spark.createDataFrame([(told["repository_sha"] if told else None,)], f"{column} string")
        for part in told["sections"] if told else ():
            out[f"{name} {part}"] = saved(spark, folder, told, part)
    one = spark.createDataFrame([(own["repository_sha"],)], "sha string")
    told = explore.story(one, shas["comparison"], shas["drivers"], shas["context"])
    rows = read_scan(spark, scan_folder)
    deepest = rows["chains"].orderBy(F.desc("depth"), "symbol_ids").limit(5)
    return {"story": told, "metrics": rows["metrics"], "symbol_metrics": rows["symbol_metrics"], "chains": deepest} | out


def scan_two(spark: SparkSession, path: str, before: str, after: str, *, keep: int = 8, **identity) -> tuple[dict[str, DataFrame], str]:
    """The comparison of two refs of one repository, and the later commit."""
    from codemass.sources import trees

    shas = [trees.resolve_commit(path, ref) for ref in (before, after)]
    commits = spark.createDataFrame([(k, sha) for k, sha in enumerate(dict.fromkeys(shas))], "frame int, sha string")
    return drivers(scan.scan_commits(spark, path, commits), *shas, keep=keep, **identity), shas[1]
