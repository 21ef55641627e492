"""Places and running sums within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codemass.llm.frames import checkpointed

_TASK = 33  # monotonically_increasing_id has the task's number above these bits


def numbered(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with _pos (from 0) and _n: a row's place in its group in the given order, and how many the group has.

    Rows are sorted once by ranges, so a large group lies in many tasks; each task's first place in a group comes from
    a table of one row for each task and group.  ``group`` columns hold no null.  Rows that are equal in
    ``order`` have any order among themselves.
    """
    at = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    at = checkpointed(at).withColumn("_task", F.shiftright("_at", _TASK))
    runs = at.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    all_rows = W.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(all_rows.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(all_rows).alias("_n"))
    placed = at.join(runs, [*group, "_task"])
    return placed.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def running(rows: DataFrame, group: list[str], piece: str, order: list[Column | str], value: str, groups: DataFrame | None = None) -> DataFrame:
    """``rows`` with _before: the sum of ``value`` over the rows of the group that come earlier by (``piece``, ``order``).

    ``piece`` cuts a group into pieces of bounded size that follow the order; sums of earlier pieces come from a table
    of one row for each piece.  The columns of ``groups``, one row a group, come with that table, so a large group's rows
    are not joined by the group alone.  ``group`` and ``piece`` hold no null.
    """
    sums = rows.groupBy(*group, piece).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*group, piece, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    if groups is not None:
        base = base.join(groups, group)
    within = W.partitionBy(*group, piece).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return rows.join(base, [*group, piece]).withColumn("_before", F.col("_base") + own).drop("_base")
