"""Summaries of runs: latency, counts, and roll-ups by embedder and by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_count, word_count
from .prefix import running
from .ranks import quantiles


def latency_summary(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Frames, mean, interpolated percentiles and frames a second of each key."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("frames"), F.avg(x).alias("_mean"))
    ranks = quantiles(rows, by, x, [0.5, 0.95]).withColumnRenamed(by, "_by")
    out = counts.join(ranks, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.select(by, "frames", F.round("_mean", 6).alias("mean_ms"), F.round("q0", 6).alias("p50_ms"), F.round("q1", 6).alias("p95_ms"), F.round(1000 / F.greatest("_mean", F.lit(1e-6)), 6).alias("fps"))


def running_latency(rows: DataFrame, by: str, order: list[str], x: str) -> DataFrame:
    """Mean of all rows so far."""
    known = rows.withColumn("_has", F.col(x).isNotNull())
    so_far = running(known, [by], order, {"_sum": x, "_n": "_has", "seen": None})
    return so_far.withColumn("running_ms", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_sum", "_n", "_has")


def run_summary(sampled: DataFrame, picks: DataFrame) -> DataFrame:
    """Counts per stream; the duration is from the first sample to the last."""
    frames = sampled.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("segment_id").alias("segments"), (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("duration_sec"))
    keys = picks.groupBy("stream_id").agg(F.count(F.lit(1)).alias("picks"))
    return frames.join(keys, "stream_id", "left").withColumn("picks", F.coalesce("picks", F.lit(0)))


def live_counters(sampled: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Frames, shots and, with picks, picks up to each frame."""
    adds = {"frames_so_far": None, "segments_so_far": "is_shot_start"}
    if picks is not None:
        marked = picks.select("stream_id", "source_idx", F.lit(True).alias("_k"))
        sampled = sampled.join(marked, ["stream_id", "source_idx"], "left")
        adds |= {"picks_so_far": "_k"}
    return running(sampled, ["stream_id"], ["timestamp_sec", "source_idx"], adds).drop("_k")


def by_embedder(rows: DataFrame) -> DataFrame:
    """A benchmark's rows, of embedders and streams, summed up for each embedder."""
    sums = [F.sum(c).alias(c) for c in ("frames", "segments", "picks")]
    return rows.groupBy("embedder").agg(F.count(F.lit(1)).alias("streams"), *sums, F.round(F.avg("jaccard"), 6).alias("jaccard"))


def caption_metrics(rows: DataFrame, model: str, text: str) -> DataFrame:
    """Captions, characters and words per model."""
    return rows.groupBy(model).agg(F.count(F.lit(1)).alias("captions"), F.sum(char_count(F.col(text))).alias("chars"), F.sum(word_count(F.col(text))).alias("words"))


def histogram_l1(rows: DataFrame, by: str, x: str, bins: int = 32, top: float = 256.0) -> DataFrame:
    """Shares of equal bins over [0, top); values outside are not counted."""
    inside = rows.where((F.col(x) >= 0) & (F.col(x) < top)).groupBy(by, F.floor(F.col(x) / (top / bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return inside.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def tail(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The newest ``most`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
