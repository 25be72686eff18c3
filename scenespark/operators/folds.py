"""Ordered folds: what depends on the rows before, with memory of one state a key.

Rows are partitioned by key and sorted within the partitions by Spark, which spills; the fold
then runs over the sorted batches and never holds a group. A key's rows are serial by their
meaning; many keys run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def values(column: pa.Array) -> list:
    """A column's values; lists of numbers as slices of one NumPy array."""
    if not pa.types.is_list(column.type) or not pa.types.is_floating(column.type.value_type) or column.flatten().null_count:
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False))
    return [flat[a:b] if ok else None for a, b, ok in zip([0, *ends[:-1]], ends, column.is_valid().to_pylist(), strict=True)] if len(column) else []


def fold(df: DataFrame, by: list[str], order: list, needs: list[str], init: Callable, step: Callable, adds: str) -> DataFrame:
    """Add columns that ``step(state, *needs)`` returns, row by row in order, for each key.

    ``init()`` makes a key's state, which ``step`` changes; ``adds`` are the new columns in DDL.
    """
    added = T._parse_datatype_string(adds)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, new = to_arrow_schema(schema), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [values(batch.column(c)) for c in [*by, *needs]]
            out = []
            for row in zip(*columns, strict=True):
                if key is None or row[: len(by)] != key:
                    key, state = row[: len(by)], init()
                out.append(step(state, *row[len(by) :]))
            made = list(zip(*out, strict=True)) if out else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(a.cast(f.type) for a, f in zip(batch.columns, arrow, strict=False)), *(pa.array(x, f.type) for x, f in zip(made, new, strict=True))], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
