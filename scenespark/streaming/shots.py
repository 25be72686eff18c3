"""Structured Streaming: sampling and shots with state per stream, and two outputs of one query."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SegmenterConfig
from ..operators.captions import caption_shots
from ..operators.segment import ShotState
from ..store import fresh_path

OUT = "stream_id long, kind string, source_idx long, timestamp_sec double, sim_to_shot_mean double, is_shot_start boolean, segment_id int, start_sec double, end_sec double, num_frames long"
STATE = "mean array<double>, start double, count long, segment int, seen long, frames long, last double, kept double"


NAMES = [x.split()[0] for x in OUT.split(", ")]


def shot_rows(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, cfg: SegmenterConfig, interval_sec: float, idle_sec: float) -> Iterator[pd.DataFrame]:
    """One stream's rows of a batch; or, when it has been idle, the shot that was open, after which its state goes."""
    s, frames_in_shot, last, kept = ShotState(cfg), 0, float("-inf"), float("-inf")
    if state.exists:
        mean, s.start, s.count, s.segment, s.seen, frames_in_shot, last, kept = state.get
        s.mean = np.array(mean, np.float64)
    out: list[tuple[Any, ...]] = []
    if state.hasTimedOut:
        state.remove()
        if s.mean is not None:
            out.append((key[0], "segment_closed", None, None, None, None, s.segment, s.start, max(last, s.start), frames_in_shot))
    else:
        rows = pd.concat(list(parts)).sort_values(["timestamp_sec", "source_idx"])
        for i, t, e in zip(rows["source_idx"], rows["timestamp_sec"], rows["embedding"], strict=True):
            if t < last or e is None:
                continue
            if interval_sec and t - kept < interval_sec:
                last = t
                continue
            last = kept = t
            start, segment = s.start, s.segment
            sim, begins, now = s.ingest(e, t)
            if begins and segment >= 0:
                out.append((key[0], "segment_closed", None, None, None, None, segment, start, t, frames_in_shot))
            frames_in_shot = 1 if begins else frames_in_shot + 1
            out.append((key[0], "frame", i, t, sim, begins, now, None, None, None))
        if s.mean is not None:
            state.update((s.mean.tolist(), s.start, s.count, s.segment, s.seen, frames_in_shot, last, kept))
            if idle_sec:
                state.setTimeoutDuration(int(idle_sec * 1000))
    df = pd.DataFrame(out, columns=NAMES)
    yield df.astype({"source_idx": "Int64", "num_frames": "Int64", "is_shot_start": "boolean"})


def stream_shots(frames: DataFrame, cfg: SegmenterConfig = SegmenterConfig(), interval_sec: float = 0.0, idle_sec: float = 0.0) -> DataFrame:
    """Frame rows and, when the next shot begins, segment_closed rows, from a stream of frames.

    With an interval, frames are first sampled greedily; both steps share a state and a
    shuffle. Rows of a batch are put in time order; those older than what a stream has seen
    are dropped. With ``idle_sec``, a stream without frames for so long has ended: its open shot is closed
    at its last frame and its state goes. Frames need stream_id, source_idx, timestamp_sec, embedding.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return shot_rows(key, parts, state, cfg, interval_sec, idle_sec)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_sec else GroupStateTimeout.NoTimeout
    return frames.groupBy(F.col("stream_id").cast("long").alias("stream_id")).applyInPandasWithState(run, OUT, STATE, "append", timeout)


def stream_sample(frames: DataFrame, interval_sec: float) -> DataFrame:
    """Greedy sampling of a stream: the first frame, then each that comes ``interval_sec`` after the last kept."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(parts)).sort_values(["timestamp_sec", "source_idx"])
        out = []
        for i, t in zip(rows["source_idx"], rows["timestamp_sec"], strict=True):
            if t - kept >= interval_sec:
                kept = t
                out.append((key[0], i, t))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["stream_id", "source_idx", "timestamp_sec"])

    return frames.groupBy(F.col("stream_id").cast("long").alias("stream_id")).applyInPandasWithState(run, "stream_id long, source_idx long, timestamp_sec double", "kept double", "append", GroupStateTimeout.NoTimeout)


def flush(rows: DataFrame) -> DataFrame:
    """The shots that a stream's end closes: each stream's last, at its last frame."""
    frames = rows.where("kind = 'frame'").groupBy("stream_id", "segment_id").agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"), F.count(F.lit(1)).alias("num_frames"))
    last = F.max("segment_id").over(Window.partitionBy("stream_id"))
    return frames.withColumn("_last", last).where("segment_id = _last").drop("_last")


def run_available(stream: DataFrame) -> DataFrame:
    """Drain a stream's sources into a Parquet table, its state in the shared folder; the table."""
    spark = stream.sparkSession
    path = fresh_path(spark)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def watermarked(frames: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark ``late`` behind its newest event time: what keeps state after it drops older rows."""
    return frames.withWatermark(ts, late)


def windowed_counts(frames: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Frames and mean sharpness per stream and window of event time; late rows are dropped, closed windows emitted."""
    return watermarked(frames, ts, late).groupBy("stream_id", F.window(ts, width)).agg(F.count(F.lit(1)).alias("frames"), F.avg("sharpness").alias("sharpness")).select("stream_id", F.col("window.start").alias("begin"), "frames", "sharpness")


def restarted(start: Callable[[], StreamingQuery], attempts: int = 3, pause_sec: float = 1.0) -> StreamingQuery:
    """Run a query to its end; after a failure begin it again, from its checkpoint, a number of times."""
    for left in range(attempts, 0, -1):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if left == 1:
                raise
            time.sleep(pause_sec)
    raise ValueError("attempts must be positive")


class Progress(StreamingQueryListener):
    """Events of streaming queries, handed on as dictionaries: init, frame (a batch's counts and rates), done."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"stage": "init", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"stage": "frame", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_sec": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"stage": "done", "query": str(event.id), "error": event.exception or ""})


def two_sinks(stream: DataFrame, frames_path: str, events_path: str, checkpoint: str, model=None, picks_of: Callable[[DataFrame], DataFrame] | None = None, captions_path: str = ""):
    """One query that writes frames to Parquet and events to JSON; start() it with the returned writer.

    A batch has folders of its own, which a repeated batch overwrites. With a model, each closed shot is
    captioned in its batch: ``picks_of`` gives the picks of the batch's closed shots.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        closed = batch.where("kind = 'segment_closed'")
        batch.where("kind = 'frame'").write.mode("overwrite").parquet(f"{frames_path}/batch={number}")
        closed.select(F.lit("segment_closed").alias("event"), "stream_id", "segment_id", F.bround("start_sec", 3).alias("start_sec"), F.bround("end_sec", 3).alias("end_sec"), F.col("num_frames").alias("frames")).write.mode("overwrite").json(f"{events_path}/batch={number}")
        if model and picks_of and captions_path:
            said = caption_shots(picks_of(closed), closed.select("stream_id", "segment_id", "start_sec", "end_sec"), model).drop("content")
            said.write.mode("overwrite").json(f"{captions_path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
