"""Command line: scan, history, movie, metabolism, atlas, path, journey, index, neighbours, context, compare, drivers, story.

Exit codes: 0 done, 1 some target of an index run failed, 2 an error.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.operators import corpus
from codemass.plans import artifacts, reports, scan
from codemass.sources import records, trees

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    """The command line's parser."""
    p = argparse.ArgumentParser(prog="codemass")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for arg in positional:
            c.add_argument(arg)
        c.add_argument("--report")
        c.add_argument("--json", help="a new folder for the result's rows")
        c.add_argument("--limit", type=int, default=20)
        return c

    c = command("scan", "path")
    c.add_argument("--config")
    c.add_argument("--canonical", action="store_true")
    c.add_argument("--rating-only", action="store_true")
    for name in ("history", "movie", "metabolism"):
        c = command(name, "path")
        c.add_argument("--to", default="HEAD")
        c.add_argument("--from", dest="first")
        c.add_argument("--max-commits", type=int, default=50)
    command("atlas", "path").add_argument("--top-level", default="no_parent", choices=("no_parent", "file_parent"))
    command("path", "path").add_argument("--capability")
    command("journey", "path").add_argument("--data")
    c = command("index", "manifest", "corpus")
    c.add_argument("--tarballs", required=True, help="folder of owner__name.tar.gz files")
    c.add_argument("--refresh", action="store_true")
    command("compare", "before", "after")
    c = command("drivers", "path")
    c.add_argument("--before", required=True)
    c.add_argument("--after", default="HEAD")
    c = command("story", "scan")
    for name in ("history", "drivers", "context"):
        c.add_argument(f"--{name}")
    for name in ("neighbours", "context"):
        c = command(name, "corpus")
        c.add_argument("--repo", required=True)
        c.add_argument("--sha")
    return p


def sections(spark: SparkSession, a: argparse.Namespace) -> list[tuple[str, DataFrame]]:
    """The named results of a command; ``a.sha`` is set to the commit that they are of, where there is one."""
    a.sha = getattr(a, "sha", None)
    identity = {"version": VERSION, "source": trees.analyzer_revision(VERSION)}
    if a.command == "scan":
        options = {}
        if a.config and not a.canonical:
            with open(a.config) as f:
                options["overrides"], options["ignore"] = records.config(spark, f.read())
        s = scan.scan_folder(spark, a.path, symbols=not a.rating_only, **options)
        a.sha = trees.static_sha(a.path)
        if a.json and not a.rating_only:
            return list(artifacts.of_scan(s, canonical=not options, sha=a.sha, **identity).items())
        return [("metrics", s.metrics), ("profiles", s.profiles)] + (
            [] if a.rating_only else [("symbol metrics", s.symbol_metrics), ("diagnostics", s.diagnostics)])
    if a.command in ("history", "movie", "metabolism"):
        commits = trees.commits(spark, a.path, a.to, first=a.first, limit=a.max_commits)
        s = scan.scan_commits(spark, a.path, commits)
        a.sha = commits.agg(F.max_by("sha", "frame")).first()[0]
        if a.command == "metabolism":
            return [("status", scan.metabolise(s, commits))]
        one, two = (scan.history if a.command == "history" else scan.movie)(s, commits)
        return [("checkpoints" if a.command == "history" else "layout", one), ("events" if a.command == "history" else "changes", two)]
    if a.command in ("atlas", "path", "journey"):
        s = scan.scan_folder(spark, a.path)
        if a.command == "journey":
            return list(scan.data_journey(s, a.data).items())
        found = scan.atlas(s, top_level=getattr(a, "top_level", "no_parent"))
        return [("capabilities", scan.atlas_reach(s, found))] if a.command == "atlas" else [
            ("paths", scan.value_path(s, found, a.capability)), ("steps", scan.value_path_steps(s, found, a.capability))]
    if a.command == "index":
        with open(a.manifest) as f:
            targets = corpus.distinct_targets(records.manifest(spark, f.read()))
        file = F.concat(F.lit(a.tarballs.rstrip("/") + "/"), F.replace("repository", F.lit("/"), F.lit("__")), F.lit(".tar.gz"))
        return [("records", scan.index(spark, targets.withColumn("path", file), a.corpus, version=VERSION, revision=identity["source"],
                    refresh=a.refresh).select("status", "identity", "reason"))]
    if a.command == "compare":
        a.sha = artifacts.head(spark, a.after, "scan")["repository_sha"]
        return list(artifacts.comparison(artifacts.read_scan(spark, a.before), artifacts.read_scan(spark, a.after)).items())
    if a.command == "drivers":
        found, a.sha = artifacts.scan_two(spark, a.path, a.before, a.after, **identity)
        return list(found.items())
    if a.command == "story":
        a.sha = artifacts.head(spark, a.scan, "scan")["repository_sha"]
        return list(artifacts.story(spark, a.scan, history=a.history, drivers=a.drivers, context=a.context).items())
    prints = corpus.fingerprints(records.flat(records.corpus(spark, a.corpus)))
    query = corpus.newest_match(prints, F.lit(a.repo), F.lit(a.sha) if a.sha else None)
    a.sha = next((r["sha"] for r in query.select("sha").limit(1).collect()), a.sha)
    return [("neighbours", corpus.neighbours(query, prints, keep=a.limit))] if a.command == "neighbours" else [("context", corpus.context(query, prints))]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; prints its rows, or writes a report."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("codemass").getOrCreate()
    began = time.monotonic()
    try:
        found = sections(spark, a)
        if a.json:
            artifacts.save(spark, a.json, a.command, a.sha, {name.replace(" ", "_"): df for name, df in found})
        if a.report:
            reports.write(a.report, f"codemass {a.command}", found)
        else:
            for name, df in found:
                print(name)
                df.show(a.limit, truncate=60)
        if a.command == "index" and found[0][1].where("status = 'failed'").count():
            return 1
    except (ValueError, OSError, PySparkException) as e:
        print(f"codemass: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 2
    print(f"{time.monotonic() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
