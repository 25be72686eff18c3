"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def var_pop(v: Column) -> Column:
    """The vector and its mean are held in arrays of one, so that each is made once a row: a lambda makes what it names anew at each element."""
    held = F.transform(F.array(doubles(v)), lambda x: F.struct(x.alias("x"), (F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).alias("mean")))
    return F.element_at(F.transform(held, lambda h: F.aggregate(h["x"], F.lit(0.0), lambda s, y: s + (y - h["mean"]) * (y - h["mean"])) / F.size(h["x"])), 1)


def np_cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))
    return float(a @ b) / size if size else 0.0


def zscore(x: Column, over) -> Column:
    """Population z-score over a window; 0 where the deviation is below 1e-9."""
    sd = F.stddev_pop(x).over(over)
    return F.when(sd < 1e-9, F.lit(0.0)).otherwise((x - F.avg(x).over(over)) / sd)
