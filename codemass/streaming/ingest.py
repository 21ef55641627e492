"""Incremental intake of a corpus folder: new JSON lines become records once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codemass.sources.records import RECORD


def records(spark: SparkSession, path: str, *, delay: str = "7 days") -> DataFrame:
    """A stream of successful records; one that repeats an identity within ``delay`` of event time is dropped."""
    rows = spark.readStream.schema(RECORD).json(path).where("status = 'ok'")
    timed = rows.withColumn("at", F.to_timestamp("scanned_at")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["identity"])


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream as Parquet until all that is there now is read."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation",
        checkpoint).outputMode("append").trigger(availableNow=True).start()
