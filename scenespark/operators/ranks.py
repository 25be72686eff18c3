"""Exact quantiles of many keys at once, by refining counted ranges of values.

A value is a number of 64 bits in the same order. Of each key, the ranges that hold the wanted ranks are
split by sixteen more bits and counted, four times; then a range is one value. A key is never gathered, and
a count has at most 65,536 rows for each rank that is sought.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import checkpoint

STEP = 16


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Bits of doubles as longs in the doubles' order; zeros are equal, and no number comes after all."""
    v = np.where(x == 0, 0.0, x.to_numpy(np.float64))
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def number_of(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def quantiles(rows: DataFrame, by: str, x: str, at: list[float]) -> DataFrame:
    """(by, q0, q1, ...): interpolated quantiles of a column for each key; nulls are left out, and a key without values has no row."""
    values = checkpoint(rows.where(F.col(x).isNotNull()).select(F.col(by).alias("_k"), ordered_bits(F.col(x).cast("double")).alias("_v")).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    sizes = values.groupBy("_k").agg(F.sum("_c").alias("n"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")) for i, q in enumerate(at) for up in (False, True)])
    # one target for each rank of a key: it lies in the range of values that share its leading bits
    targets = checkpoint(sizes.select("_k", "n", F.explode(places).alias("p")).select("_k", F.col("p.rank").alias("rank")).distinct().withColumn("left", F.col("rank")).withColumn("lead", F.lit(0).cast("long")))
    ranks = sizes.select("_k", "n", F.explode(places).alias("p")).select("_k", "n", "p.i", "p.up", "p.rank")
    for shift in range(64 - STEP, -1, -STEP):
        inside = F.lit(0).cast("long") if shift + STEP == 64 else F.shiftright("_v", shift + STEP)
        # of all ranks with one range, the range is counted once
        open_ranges = targets.select(F.col("_k").alias("_tk"), F.col("lead").alias("_lead")).distinct()
        counted = values.withColumn("_in", inside).join(open_ranges, F.col("_k").eqNullSafe(F.col("_tk")) & (F.col("_in") == F.col("_lead")), "left_semi").groupBy("_k", "_in", F.shiftright("_v", shift).alias("_cell")).agg(F.sum("_c").alias("_c"))
        upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_k", "_in").orderBy("_cell")))
        found = targets.join(upto.withColumnRenamed("_k", "_ck"), F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("lead") == F.col("_in")) & (F.col("left") < F.col("_upto")) & (F.col("left") >= F.col("_upto") - F.col("_c")))
        targets = checkpoint(found.select("_k", "rank", (F.col("left") - F.col("_upto") + F.col("_c")).alias("left"), F.col("_cell").alias("lead")))
    exact = targets.select(F.col("_k").alias("_tk"), F.col("rank").alias("_rank"), number_of("lead").alias("value"))
    both = ranks.join(exact, F.col("_k").eqNullSafe(F.col("_tk")) & (F.col("rank") == F.col("_rank")))
    ends = both.groupBy("_k").agg(F.first("n").alias("n"), *[F.max(F.when((F.col("i") == i) & (F.col("up") == F.lit(up)), F.col("value"))).alias(f"v{i}{int(up)}") for i in range(len(at)) for up in (False, True)])
    out = []
    for i, q in enumerate(at):
        place = F.lit(q) * (F.col("n") - 1)
        part = place - F.floor(place)
        out.append((F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * part).alias(f"q{i}"))
    return ends.select(F.col("_k").alias(by), *out)
