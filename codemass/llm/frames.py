"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codemass.functions.checkpoint import checkpoint_dir as ensure_checkpoint_dir
from codemass.functions.checkpoint import checkpointed

__all__ = ["append_columns", "checkpointed", "ensure_checkpoint_dir", "free_name"]


def append_columns(df: DataFrame, fields: Sequence[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each Arrow batch.

    A column of ``df`` whose name clashes with a new one (in any letter case) is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    keep = [f.name for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + list(fields))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + made, names=keep + [f.name for f in fields]
            )

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
