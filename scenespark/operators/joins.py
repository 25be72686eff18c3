"""Joins of frames and picks: by rounded time, nearest in time, and one to one within a tolerance."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def mark_picks(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """All frames, with the pick at the same time to three places, or null."""
    k = picks.select("stream_id", F.bround("timestamp_sec", 3).alias("_t"), "pick_id")
    return frames.withColumn("_t", F.bround("timestamp_sec", 3)).join(k, ["stream_id", "_t"], "left").drop("_t")


def only_picks(frames: DataFrame, picks: DataFrame) -> DataFrame:
    k = picks.select("stream_id", F.bround("timestamp_sec", 3).alias("_t"))
    return frames.withColumn("_t", F.bround("timestamp_sec", 3)).join(k, ["stream_id", "_t"], "left_semi").drop("_t")


def nearest(frames: DataFrame, points: DataFrame, key: str = "stream_id", cell_sec: float = 86400.0) -> DataFrame:
    """For each point (key, point, t) the nearest frame in time; of equally near ones the earlier, then the smaller ``source_idx``.

    Points and frames are merged in time order within cells of ``cell_sec`` of a stream, so that a stream of any
    length is many tasks'. The last frame before a cell and the first after it come from one row for each
    cell. Frames without a time are not read; a point without one, or whose stream has no frames, gets nulls.
    """
    cell = F.floor(F.col("t") / cell_sec).alias("cell")
    own = frames.where("timestamp_sec is not null").select(key, F.col("timestamp_sec").alias("t"), F.struct(F.col("timestamp_sec").alias("t"), F.col("source_idx").cast("long").alias("source_idx")).alias("f"))
    rows = own.select(key, "t", cell, F.lit(False).alias("asks"), F.lit(None).cast("long").alias("point"), "f")
    marks = points.select(key, "t", cell, F.lit(True).alias("asks"), F.col("point").cast("long").alias("point"), F.lit(None).cast(own.schema["f"].dataType).alias("f"))
    every = rows.unionByName(marks)
    # One sort for each direction, frames before points of their time: a window without an end would be read anew for every row.
    here, tie = Window.partitionBy(key, "cell"), [F.col("asks"), F.col("f.source_idx").desc_nulls_first()]
    so_far = [w.rowsBetween(Window.unboundedPreceding, 0) for w in (here.orderBy(F.col("t"), *tie), here.orderBy(F.col("t").desc(), *tie))]
    met = every.select("*", *[F.last("f", ignorenulls=True).over(w).alias(c) for c, w in zip("ba", so_far, strict=True)]).where("asks")
    # of a cell's last frames the smallest index, as of its first ones
    ends = every.groupBy(key, "cell").agg(F.min("f").alias("low"), F.max(F.when(F.col("f").isNotNull(), F.struct("f.t", (-F.col("f.source_idx")).alias("s")))).alias("high"))
    ends = ends.withColumn("high", F.when(F.col("high").isNotNull(), F.struct("high.t", (-F.col("high.s")).alias("source_idx"))))
    line = Window.partitionBy(key)
    earlier, later = (line.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("cell").asc_nulls_first(), F.col("cell").desc_nulls_first()))
    beyond = ends.select(F.col(key).alias("_key"), F.col("cell").alias("_cell"), F.last("high", ignorenulls=True).over(earlier).alias("_b"), F.last("low", ignorenulls=True).over(later).alias("_a"))
    met = met.join(beyond, F.col(key).eqNullSafe(F.col("_key")) & (F.col("cell") == F.col("_cell")), "left").select(key, "point", "t", F.coalesce("b", "_b").alias("b"), F.coalesce("a", "_a").alias("a"))
    found = F.when(F.col("b").isNull() | (F.abs(F.col("a.t") - F.col("t")) < F.abs(F.col("t") - F.col("b.t"))), F.col("a")).otherwise(F.col("b"))
    return met.select(key, "point", "t", found.alias("f")).select(key, "point", "t", F.col("f.t").alias("frame_t"), F.col("f.source_idx").alias("source_idx"))


class FreeTimes:
    """Times of ``b`` within reach of those of ``a`` that are still to come, in order: the only state of a match."""

    def __init__(self) -> None:
        self.free: list[float] = []

    def take(self, t: float, reach: float) -> bool:
        """Take the free time nearest to ``t``, the later of two equally near ones, if it is within reach."""
        gone = bisect_left(self.free, t - 2 * reach)
        del self.free[:gone]
        k = bisect_left(self.free, t)
        off = [abs(self.free[i] - t) if 0 <= i < len(self.free) else float("inf") for i in (k - 1, k)]
        near = k if off[1] <= off[0] else k - 1
        if off[near - k + 1] > reach:
            return False
        del self.free[near]
        return True


def match_times(rows: DataFrame, by: list[str], tolerance: float, keys: DataFrame | None = None) -> DataFrame:
    """How many times of side ``a`` find a time of side ``b`` of their own within ``tolerance``.

    ``rows``: the keys, side ("a" or "b") and t; nulls are left out. Each a in order of time takes the nearest b that is free, the later of equally near
    ones. Both sides are merged in the order in which an a can be decided, when all times within its reach have gone by, so that one
    pass holds no more than the free times within reach. Columns matched, n_a, n_b, jaccard. ``keys``: those that get a row, with 0, 0, 0 and 1 where
    neither side has a time; else those that have one.
    """
    reach = tolerance + 1e-9
    merged = rows.where("t is not null").select(*by, "side", F.col("t").cast("double").alias("t"))
    merged = merged.withColumn("_due", F.when(F.col("side") == "a", F.col("t") + reach + 1e-6 * (1 + F.abs("t") * 1e-6)).otherwise(F.col("t")))

    def step(state: FreeTimes, side: str, t: float) -> tuple[int]:
        if side == "b":
            insort(state.free, t)
            return (0,)
        return (int(state.take(t, reach)),)

    told = fold(merged, by, ["_due", F.col("side").desc(), "t"], ["side", "t"], FreeTimes, step, "hit long")
    one = lambda side: F.sum((F.col("side") == side).cast("long"))
    out = told.groupBy(*by).agg(F.sum("hit").alias("matched"), one("a").alias("n_a"), one("b").alias("n_b"))
    if keys is not None:
        none = F.lit(0).cast("long")
        out = keys.select(*by).distinct().join(out, by, "left").select(*by, *[F.coalesce(c, none).alias(c) for c in ("matched", "n_a", "n_b")])
    either = F.col("n_a") + F.col("n_b") - F.col("matched")
    return out.withColumn("jaccard", F.when(either == 0, F.lit(1.0)).otherwise(F.col("matched") / either))


def with_images(picks: DataFrame, images: DataFrame) -> DataFrame:
    """Picks with the bytes of the image that ``bgr_path`` names, or null where it cannot be read.

    images: (path, content), as the binaryFile source gives them.
    """
    own = images.select(F.regexp_replace("path", "^file:/+", "/").alias("_p"), F.col("content").alias("image"))
    return picks.withColumn("_p", F.regexp_replace("bgr_path", "^file:/+", "/")).join(own, "_p", "left").drop("_p")
