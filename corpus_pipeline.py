"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.llm import decontaminate, frames, langid, packing, simhash, substring
from codemass.llm.queries import tokenizer_path

#: Rows of an Arrow batch: documents are some KB each, so a batch stays at some MB in the JVM and in Python.
BATCH_ROWS, BATCH_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches until the stage's result is written; ``run`` restores what was set before."""
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; null texts and those without any letter go.

    Where no row is labelled there is nothing to learn, and every document with a letter stays.
    """
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    kept = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    net = langid.train(docs.where(~kept))
    nothing_learned = F.lit(net.classes == [langid.UNKNOWN]) & F.col("text").rlike(r"\p{L}")
    return langid.identify(docs, net).where((F.col("lang_pred") != langid.UNKNOWN) | nothing_learned).select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, a digest of the row's values: rows of one digest are the same in every column."""
    digests = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in COLUMNS]
    return docs.select(*COLUMNS, F.sha2(F.concat_ws(",", *digests), 256).alias("_row"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: that of smallest doc_id, rows without one last.

    Rows that repeat a doc_id are judged each on their own; the digest of a row's values chooses among them.
    """
    _small_batches(spark)
    rows = _named(docs)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    found = simhash.near_duplicates(rows.select(name.alias("_name"), "text"), key="_name").where("_name <=> component_id")
    keys = found.select(F.col("_name._row").alias("_row")).distinct()
    return rows.join(keys, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 13-word windows that an earlier document has; documents with nothing left go."""
    _small_batches(spark)
    done = substring.deduplicate(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = done.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item; rows that repeat a doc_id or have none are judged each on their own."""
    _small_batches(spark)
    rows = _named(docs)
    leaks = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    return rows.join(leaks.select("_row").distinct(), "_row", "left_anti").select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row for each piece."""
    _small_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: SQL expresses neither the network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again.

    A stage's folder goes once the next is written; the last one stays for the returned frame.  The session's settings
    are as before when it returns.
    """
    folder = f"{frames.ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, spark.conf.get(BATCH_KEY)
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
            if last:
                _remove(spark, last)
            last = out
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
