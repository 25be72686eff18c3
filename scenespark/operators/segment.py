"""Shots of ordered frames: a running mean of embeddings, cut where a frame is unlike it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SegmenterConfig
from ..functions.vectors import np_cosine
from .prefix import running
from .speculate import stitched


class ShotState:
    """The open shot of one stream: mean, start, frames, and numbers given so far."""

    def __init__(self, cfg: SegmenterConfig):
        self.cfg, self.mean, self.start, self.count, self.segment, self.seen = cfg, None, 0.0, 0, -1, 0

    def ingest(self, embedding, t: float) -> tuple[float, bool, int]:
        """(similarity to the mean before this frame, whether it opens a shot, its shot)."""
        x = np.asarray(embedding, np.float64)
        self.seen += 1
        if self.mean is None:
            return self._open(x, t, 1.0)
        sim = np_cosine(x, self.mean)
        if sim < self.cfg.sim_threshold and t - self.start >= self.cfg.min_shot_sec:
            return self._open(x, t, sim)
        if self.cfg.use_ema:
            self.mean = self.cfg.ema_alpha * x + (1 - self.cfg.ema_alpha) * self.mean
        else:
            self.mean = (self.mean * self.count + x) / (self.count + 1)
        self.count += 1
        return sim, False, self.segment

    def _open(self, x: np.ndarray, t: float, sim: float) -> tuple[float, bool, int]:
        self.mean, self.start, self.count = x, t, 1
        self.segment += 1
        return sim, True, self.segment

    def finalise(self) -> int | None:
        """Close the open shot; its number, or None. Numbering goes on."""
        if self.mean is None:
            return None
        self.mean = None
        return self.segment


def segment_frames(frames: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Frames with sim_to_shot_mean, is_shot_start, segment_id; a sort by stream and time over ranges, so that a long stream lies in many tasks.

    Pieces of a stream are folded side by side and stitched (``speculate``). Frames without an embedding are left
    out: nothing can be compared with them. Times and numbers of a stream's frames should differ.
    """
    return stitched(frames.where("embedding is not null"), "stream_id", ["timestamp_sec", "source_idx"], lambda: ShotState(cfg))[0]


def segment_frames_sql(frames: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """The same by a fold of column functions over each stream's sorted frames: for short streams."""
    e = "transform(x.embedding, v -> cast(v as double))"
    mean = f"zip_with({e}, s.mean, (v, m) -> {cfg.ema_alpha}D * v + {1 - cfg.ema_alpha}D * m)" if cfg.use_ema else f"zip_with({e}, s.mean, (v, m) -> (m * s.n + v) / (s.n + 1))"
    size = lambda v: f"sqrt(aggregate({v}, 0D, (a, b) -> a + b * b))"
    sim = f"if({size(e)} * {size('s.mean')} = 0, 0D, aggregate(zip_with({e}, s.mean, (v, m) -> v * m), 0D, (a, b) -> a + b) / ({size(e)} * {size('s.mean')}))"
    cut = f"(s.sid < 0 or (q.sim < {cfg.sim_threshold}D and x.timestamp_sec - s.start >= {cfg.min_shot_sec}D))"
    state = f"""transform(array(named_struct('sim', if(s.sid < 0, 1D, {sim}))), q -> named_struct(
        'mean', if{cut[:-1]}, {e}, {mean}), 'start', if{cut[:-1]}, x.timestamp_sec, s.start), 'n', if{cut[:-1]}, 1, s.n + 1), 'sid', if{cut[:-1]}, s.sid + 1, s.sid),
        'out', concat(s.out, array(named_struct('source_idx', x.source_idx, 'sim_to_shot_mean', q.sim, 'is_shot_start', {cut}, 'segment_id', if{cut[:-1]}, s.sid + 1, s.sid))))))[0]"""
    zero = "named_struct('mean', cast(array() as array<double>), 'start', 0D, 'n', 0, 'sid', -1, 'out', cast(array() as array<struct<source_idx: bigint, sim_to_shot_mean: double, is_shot_start: boolean, segment_id: int>>))"
    rows = frames.where("embedding is not null").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_sec", "source_idx", "embedding"))).alias("xs"))
    return rows.select("stream_id", F.expr(f"explode(aggregate(xs, {zero}, (s, x) -> {state}).out)").alias("r")).select("stream_id", "r.*")


def segment_rollup(sampled: DataFrame) -> DataFrame:
    """A row per shot. A shot ends where the next begins; the last at its last frame."""
    per = sampled.groupBy("stream_id", "segment_id").agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("last_sec"), F.count(F.lit(1)).alias("num_frames"))
    after = F.lead("start_sec").over(Window.partitionBy("stream_id").orderBy("segment_id"))
    end = F.coalesce(after, F.greatest("last_sec", "start_sec"))
    out = per.withColumn("end_sec", end).withColumn("closed_in_stream", after.isNotNull())
    return out.withColumn("duration_sec", F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0))).drop("last_sec")


def event_log(sampled: DataFrame) -> DataFrame:
    """The events of closed shots; a stream's last shot is closed by its end and logged by none."""
    return segment_rollup(sampled).where("closed_in_stream").select("stream_id", F.lit("segment_closed").alias("event"), "segment_id", F.bround("start_sec", 3).alias("start_sec"), F.bround("end_sec", 3).alias("end_sec"), F.col("num_frames").alias("frames"))


def segment_from_flags(frames: DataFrame) -> DataFrame:
    """The shot of each frame from start flags alone: their running count, from 0."""
    so_far = running(frames, ["stream_id"], ["timestamp_sec", "source_idx"], {"_starts": "is_shot_start"})
    return so_far.withColumn("segment_from_flags", F.greatest(F.col("_starts") - 1, F.lit(0)).cast("int")).drop("_starts")
