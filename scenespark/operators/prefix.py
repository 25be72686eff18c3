"""Running totals of keys of any size: a sort by ranges, and totals that are carried from partition to partition.

A key with most of all rows lies in many partitions, each in order. A partition's own totals are cumulative
sums; what stood before it is known from one row for each partition, as only its first key can have begun
in an earlier one. Nothing is shuffled but the sort, and no task has more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..store import checkpoint


def in_order(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows sorted by key and order over ranges, kept as they lie: a later read finds the same partitions."""
    return checkpoint(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order))


def key_starts(batch: pa.RecordBatch, key: list[str], before: tuple | None) -> tuple[np.ndarray, tuple, tuple]:
    """Where a key's rows begin in a sorted batch (as flags), and the first and the last row's keys."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in key:
        codes = batch.column(k).dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first, last = (tuple(batch.column(k)[i].as_py() for k in key) for i in (0, n - 1))
    new[0] = before is None or first != before
    return new, first, last


def cumulative(x: np.ndarray, new: np.ndarray, carried: Any) -> np.ndarray:
    """Sums so far since the last flag; what was ``carried`` counts until the first flag."""
    total = np.cumsum(x)
    begin = np.flatnonzero(new)
    out = total.copy()
    if len(begin):
        before = total[begin] - x[begin]
        size = np.diff([*begin, len(x)])
        out[begin[0] :] -= np.repeat(before, size)
        out[: begin[0]] += carried
    else:
        out += carried
    return out


def carries(parts: list[dict]) -> dict[int, list]:
    """For each partition whose first key began earlier, that key's totals before it. ``parts``: a summary of each partition."""
    out: dict[int, list] = {}
    last_key, totals = None, []
    for p in sorted(parts, key=lambda p: p["part"]):
        first, last = tuple(p["first"]), tuple(p["last"])
        goes_on = last_key is not None and first == last_key
        if goes_on:
            out[p["part"]] = totals
        one = p["keys"] == 1
        totals = [a + b for a, b in zip(p["totals"], totals, strict=True)] if one and goes_on else p["totals"]
        last_key = last
    return out


def running(df: DataFrame, key: list[str], order: list[str], adds: dict[str, str | None]) -> DataFrame:
    """Add the totals of a key's rows so far, this one included: of a numeric column, nulls counting nothing, or, for None, of the rows.

    The order should be total within a key; equal rows are numbered in any order.
    """
    rows = in_order(df, key, order)
    kinds = {n: T.LongType() if c is None or isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType)) else T.DoubleType() for n, c in adds.items()}

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column, kind = adds[name], np.int64 if isinstance(kinds[name], T.LongType) else np.float64
        if column is None:
            return np.ones(batch.num_rows, kind)
        return pc.fill_null(batch.column(column).cast(pa.int64() if kind is np.int64 else pa.float64()), 0).to_numpy(zero_copy_only=False)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, keys, totals = None, None, 0, [0.0] * len(adds)
        for batch in batches:
            if not batch.num_rows:
                continue
            new, head, last = key_starts(batch, key, before)
            first, before, keys = first if first is not None else head, last, keys + int(new.sum())
            totals = [float(cumulative(numbers(batch, n), new, t)[-1]) if isinstance(kinds[n], T.DoubleType) else int(cumulative(numbers(batch, n), new, int(t))[-1]) for n, t in zip(adds, totals, strict=True)]
        if first is not None:
            import pickle

            yield pa.RecordBatch.from_pydict({"x": [pickle.dumps({"part": TaskContext.get().partitionId(), "first": first, "last": before, "keys": keys, "totals": totals})]}, pa.schema([("x", pa.binary())]))

    import pickle

    found = rows.select(*key, *{c for c in adds.values() if c and c not in key}).mapInArrow(summaries, "x binary").collect()  # a row for each partition
    carried = carries([pickle.loads(bytes(r["x"])) for r in found])
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = carried.get(TaskContext.get().partitionId())
        before, totals, begun = None, own or [0] * len(adds), own is not None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, _, last = key_starts(batch, key, before)
            if begun:  # the first key goes on from an earlier partition
                new[0], begun = False, False
            made = [cumulative(numbers(batch, n), new, t) for n, t in zip(adds, totals, strict=True)]
            before, totals = last, [m[-1] for m in made]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *(pa.array(m) for m in made)], schema=arrow)

    return rows.mapInArrow(add, schema)
