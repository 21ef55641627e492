"""Rows of small files over many tasks, and joins of large relations in small files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, by the columns or in turn: a file of few bytes is read by one task, and what each
    of its rows grows into would be sorted there."""
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def apart(df: DataFrame) -> DataFrame:
    """``df`` so that joins shuffle it: a size that is guessed from compressed files may be a hundredth of its rows', which would all go
    through the driver to every executor."""
    return df.hint("merge")
