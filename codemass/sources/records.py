"""Measurement records as append-only JSON lines, manifests, and reports."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = (
    "status string, scanned_at string, identity string, repository struct<name:string,sha:string,id:string>, analyzer struct<name:string,version:string,source_revision:string,canonical:boolean>,"
    " measurement struct<measurement_model:string,category_code_lines:map<string,double>,category_symbol_counts:map<string,double>,"
    "baseline:struct<direct_product_share:double,tooling_share:double,scaffolding_ratio:double>,"
    "semantic:struct<relationship_count:double,exact_resolution_rate:double,max_recursive_depth:double,semantic_recursion_index:double,far_from_value_symbol_share:double>>,"
    " reason struct<code:string,message:string>"
)


def ordered(value: Column, kind: T.DataType, name: str) -> Column:
    """``value`` with the keys of all structs and maps within it in order; a number that is not finite fails, under its name."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[ordered(value.getField(f.name), f.dataType, f"{name}.{f.name}").alias(f.name) for f in fields]))
    if isinstance(kind, T.MapType):
        entry = lambda k: F.struct(k.alias("key"), ordered(F.element_at(value, k), kind.valueType, f"{name}[]").alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(value)), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType, f"{name}[]"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(odd, F.raise_error(F.lit(f"{name} is not a finite number"))).otherwise(value)
    return value


def append(records: DataFrame, path: str) -> None:
    """Adds records to a corpus folder as JSON lines with sorted keys at every depth; skipped ones are not kept.

    A record with a number that is not finite fails the batch, and a batch that fails adds no record.
    """
    rows = records.where("status <> 'skipped'")
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    rows.select(*[ordered(F.col(f.name), f.dataType, f.name).alias(f.name) for f in fields]).write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a corpus has been written at a path that Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _broken(line: Column) -> Column:
    return (F.trim(line) != "") & (F.try_parse_json(line).isNull() | ~F.trim(line).startswith("{"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, lines, text): of each split of a corpus the number of the first line that is no JSON object, how many such lines it has,
    and the first's first words.

    Files are read in splits, in parallel; a split counts its lines where it is read, and the sums of the splits before it in
    its file are added to its own line numbers.  What is shuffled is a row a split.  Blank lines are counted and not broken.
    """
    at = F.monotonically_increasing_id().alias("_id")  # follows the order of lines within a split
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), at)
    bad = F.when(_broken(F.col("value")), F.struct("_id", F.substring("value", 1, 80).alias("text")))
    splits = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.count(bad).alias("lines"), F.min(bad).alias("_bad"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = splits.withColumn("line", before + F.col("_bad._id") - F.col("_first") + 1)
    return numbered.where("lines > 0").select("file", "line", "lines", F.col("_bad.text").alias("text"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of a corpus; blank lines are skipped.  Lines that are no JSON objects are a ValueError that names the first's file and number."""
    if bad := broken_lines(spark, path).orderBy("file", "line").first():
        raise ValueError(f"not a JSON record: {bad['file']}, line {bad['line']}: {bad['text']}")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def flat(records: DataFrame) -> DataFrame:
    """Successful records with a measurement, as corpus.fingerprints reads them."""
    m = "measurement"
    return records.where("status = 'ok' and measurement is not null").select(
        F.col("repository.name").alias("repository"), F.col("repository.sha").alias("sha"), "scanned_at",
        F.monotonically_increasing_id().alias("seq"), F.col("analyzer.version").alias("version"),
        F.col("analyzer.source_revision").alias("revision"), F.coalesce("analyzer.canonical", F.lit(True)).alias("canonical"),
        F.col(f"{m}.measurement_model").alias("model"),
        F.col(f"{m}.category_code_lines").alias("category_lines"), F.col(f"{m}.category_symbol_counts").alias("category_symbols"),
        F.col(f"{m}.semantic.relationship_count").alias("relationship_count"),
        F.col(f"{m}.semantic.exact_resolution_rate").alias("exact_resolution_rate"), F.col(f"{m}.semantic.max_recursive_depth").alias("max_recursive_depth"),
        F.col(f"{m}.semantic.semantic_recursion_index").alias("semantic_index"), F.col(f"{m}.semantic.far_from_value_symbol_share").alias("far_share"),
        F.col(f"{m}.baseline.scaffolding_ratio").alias("scaffolding_ratio"), F.col(f"{m}.baseline.direct_product_share").alias("product_share"),
        F.col(f"{m}.baseline.tooling_share").alias("machinery_share"),
    )


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """(seq, repository, sha) of a manifest: a list, or an object with targets; items are names or objects with repo or repository."""
    data = json.loads(text)
    items = data.get("targets") if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ValueError("a manifest is a list or has a list of targets")
    rows = []
    for k, item in enumerate(items):
        name = item if isinstance(item, str) else item.get("repo") or item.get("repository") if isinstance(item, dict) else None
        sha = item.get("sha") if isinstance(item, dict) else None
        if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", name):
            raise ValueError(f"target {k} names no owner/repository")
        if sha is not None and not re.fullmatch("[0-9a-fA-F]{40}", str(sha)):
            raise ValueError(f"target {k} has no full commit hash")
        rows.append((k, name, sha))
    return spark.createDataFrame(rows, "seq int, repository string, sha string")


def config(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Overrides (prefix, category, seq) and ignored prefixes of a configuration text; unknown categories fail."""
    from codemass.schema import CATEGORIES

    data = json.loads(text)
    rows = [(p, c, k) for k, (c, p) in enumerate((c, p) for c, prefixes in (data.get("paths") or {}).items() for p in prefixes)]
    if bad := {c for _, c, _ in rows} - set(CATEGORIES):
        raise ValueError(f"unknown categories: {sorted(bad)}")
    return spark.createDataFrame(rows, "prefix string, category string, seq int"), spark.createDataFrame([(p,) for p in data.get("ignore") or []],
        "prefix string")


def write_json(row: DataFrame, path: str) -> None:
    """One row as an indented JSON file with sorted keys, written whole or not at all; NaN and infinities fail."""
    value = json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"], parse_constant=_refuse)
    data = json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"
    if '"NaN"' in data or '"Infinity"' in data or '"-Infinity"' in data:
        raise ValueError("a report holds a number that is not finite")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(data)
    os.replace(path + ".tmp", path)


def _refuse(name: str) -> float:
    raise ValueError(f"a report holds {name}")
