"""Shots by event time: late rows wait for the watermark, shots close with their picks, dead streams leave.

State per stream lies in the state store under names of its own: rows that wait for the watermark (a list,
which arrivals append to), the open shot, its frames so far (a list) and the sum of their vectors.
An event-time timer wakes a stream when the watermark has passed its first waiting row, or when nothing
has come for so long that the stream has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..config import CaptionerConfig, SegmenterConfig, SelectorConfig
from ..functions.text import shot_header
from ..operators.captions import caption, part
from ..operators.segment import ShotState
from ..store import fresh_path, written

PICKS = "array<struct<pick_id:int,source_idx:bigint,timestamp_sec:double,rank_in_segment:int,composite_score:double,representativeness:double,sharpness:double>>"
OUT = f"stream_id long, began double, kind string, source_idx long, timestamp_sec double, sim_to_shot_mean double, is_shot_start boolean, segment_id int, start_sec double, end_sec double, num_frames long, closed_by string, picks {PICKS}"
NAMES = ["stream_id", "began", "kind", "source_idx", "timestamp_sec", "sim_to_shot_mean", "is_shot_start", "segment_id", "start_sec", "end_sec", "num_frames", "closed_by", "picks"]
ROW = "source_idx long, timestamp_sec double, sharpness double, embedding array<float>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_micros(t: float) -> int:
    """A frame's event time: a second after its own, as a row at Spark's first watermark, the epoch, would be late."""
    return int((t + 1.0) * 1e6)


def half_up(x: np.ndarray, places: int = 6) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10**places + 0.5) / 10**places


def z(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / sd if sd >= 1e-9 else np.zeros_like(x)


def picks_of_shot(rows: list[tuple], total: np.ndarray, start: float, end: float, cfg: SelectorConfig, numbered: int) -> list[dict[str, Any]]:
    """The picks of one closed shot, numbered on from ``numbered``: the batch operators' scores, order and spacing."""
    idx, t, sharp = (np.array([r[k] for r in rows], kind) for k, kind in ((0, np.int64), (1, float), (2, float)))
    x = np.array([r[3] for r in rows], float)
    centre = total / len(rows)
    size = np.sqrt((x * x).sum(1)) * np.sqrt(centre @ centre)
    like = np.divide(x @ centre, size, out=np.zeros(len(x)), where=size > 0)
    if len(rows) == 1:
        like, score = np.ones(1), np.zeros(1)
    else:
        score = half_up(cfg.sharpness_weight * z(sharp) + cfg.representativeness_weight * z(like))
    most = cfg.max_frames_per_segment if cfg.seconds_per_pick <= 0 else max(1, min(cfg.max_frames_per_segment, int(np.ceil(max(end - start, 0.0) / cfg.seconds_per_pick))))
    taken: list[tuple[int, int]] = []
    for rank, k in enumerate(np.lexsort((idx, t, -score))):
        if not taken or (len(taken) < most and all(abs(t[k] - t[j]) >= cfg.min_temporal_spacing_sec for j, _ in taken)):
            taken.append((int(k), rank))
    taken.sort(key=lambda p: (t[p[0]], idx[p[0]]))
    return [{"pick_id": numbered + n, "source_idx": int(idx[k]), "timestamp_sec": float(t[k]), "rank_in_segment": rank, "composite_score": float(score[k]), "representativeness": float(like[k]), "sharpness": float(sharp[k])} for n, (k, rank) in enumerate(taken, 1)]


class Shots(StatefulProcessor):
    """One stream's shots: see ``stream_ordered``."""

    def __init__(self, cfg: SegmenterConfig, sel: SelectorConfig, interval_sec: float, idle_sec: float):
        self.cfg, self.sel, self.interval_sec, self.idle_sec = cfg, sel, interval_sec, idle_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.frames = handle.getListState("frames", ROW)
        self.open = handle.getValueState("open", "mean array<double>, total array<double>, start double, count long, segment int, frames long, last double, kept double, picks int, began double")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int | None) -> None:
        """Have one timer, at the given millisecond, or none."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part_ in rows:
            got = [(int(i), float(t), None if s is None or s != s else float(s), [float(v) for v in e]) for i, t, s, e in zip(part_["source_idx"], part_["timestamp_sec"], part_["sharpness"], part_["embedding"], strict=True) if e is not None]
            if got:
                self.waiting.appendList(got)
                first = min([r[1] for r in got] + ([first] if first is not None else []))
        if first is not None:
            due = -(-event_micros(first) // 1000)
            self.wake(min(due, self.timer.get()[0]) if self.timer.exists() else due)
        yield pd.DataFrame(columns=NAMES)

    def close_shot(self, key, rows: list[tuple], began: float, s: ShotState, total: np.ndarray, n: int, picks: int, end: float, by: str) -> tuple:
        found = picks_of_shot(rows, total, s.start, end, self.sel, picks)
        return (key[0], began, "segment_closed", None, None, None, None, s.segment, s.start, end, n, by, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # an expired timer is gone
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        due = [r for r in rows if event_micros(r[1]) <= mark * 1000]
        rest = rows[len(due) :]
        s, total, n, last, kept, picks, began = ShotState(self.cfg), np.zeros(0), 0, float("-inf"), float("-inf"), 0, 0.0
        if self.open.exists():
            mean, sums, s.start, s.count, s.segment, n, last, kept, picks, began = self.open.get()
            s.mean, total = np.array(mean, float), np.array(sums, float)
        out: list[tuple] = []
        new: list[tuple] = []
        stored = n > 0

        def close(end: float, by: str) -> None:
            nonlocal new, n, picks, stored
            # only the shot that was open before has frames in the store
            rows_of = [*self.frames.get(), *new] if stored else new
            if stored:
                self.frames.clear()
            new, stored = [], False
            out.append(self.close_shot(key, rows_of, began, s, total, n, picks, end, by))
            picks += len(out[-1][-1])
            n = 0

        for r in due:
            i, t, sharp, e = r
            if self.idle_sec and t - last > self.idle_sec and s.mean is not None:
                close(max(last, s.start), "idle")
                s, picks, kept = ShotState(self.cfg), 0, float("-inf")
            last = t
            if self.interval_sec and t - kept < self.interval_sec:
                continue
            kept = t
            x = np.asarray(e, float)
            before, start = s.segment, s.start
            began = t if before < 0 else began
            sim, begins, now = s.ingest(x, t)
            if begins and before >= 0 and n:
                # the shot before ends where this one begins
                s.segment, s.start, after = before, start, (s.segment, s.start)
                close(t, "cut")
                s.segment, s.start = after
            total = x.copy() if begins else total + x
            n += 1
            new.append((i, t, 0.0 if sharp is None else sharp, e))
            out.append((key[0], began, "frame", i, t, sim, begins, now, None, None, None, None, None))
        ended = self.idle_sec and not rest and s.mean is not None and event_micros(last + self.idle_sec) <= mark * 1000
        if ended:
            close(max(last, s.start), "idle")
            self.open.clear()
            self.waiting.clear()
        else:
            if new:
                self.frames.appendList(new)
            if due:
                if rest:
                    self.waiting.put(rest)
                else:
                    self.waiting.clear()
            if s.mean is not None:
                self.open.update((s.mean.tolist(), total.tolist(), s.start, s.count, s.segment, n, last, kept, picks, began))
            nexts = [-(-event_micros(rest[0][1]) // 1000)] if rest else [-(-event_micros(last + self.idle_sec) // 1000)] if self.idle_sec and s.mean is not None else []
            self.wake(nexts[0] if nexts else None)
        yield pd.DataFrame(out, columns=NAMES).astype({"source_idx": "Int64", "num_frames": "Int64", "segment_id": "Int32", "is_shot_start": "boolean"})

    def close(self) -> None:
        pass


def stream_ordered(frames: DataFrame, cfg: SegmenterConfig = SegmenterConfig(), sel: SelectorConfig = SelectorConfig(), interval_sec: float = 0.0, late_sec: float = 60.0, idle_sec: float = 0.0) -> DataFrame:
    """Frame rows and, as each shot closes, a segment_closed row with its picks, whatever order rows come in.

    Frames need stream_id, source_idx, timestamp_sec (0 or more), sharpness, embedding. A row waits until the watermark, ``late_sec``
    behind the newest frame of all streams, has passed it; rows later than that are dropped by Spark and counted in its
    progress. Rows of equal time go by source_idx; rows without an embedding are left out. With ``idle_sec``, a stream without frames
    for so long, in event time, has ended: its open shot closes at its last frame, its state goes, and frames that come
    later begin anew, with shots and picks numbered from their beginnings; ``began``, the first frame's time, tells these apart. The state store must be RocksDB (``started`` sees to it).
    """
    at = F.timestamp_micros(((F.col("timestamp_sec") + 1.0) * 1e6).cast("long"))
    rows = frames.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("source_idx").cast("long").alias("source_idx"), F.col("timestamp_sec").cast("double").alias("timestamp_sec"), F.col("sharpness").cast("double").alias("sharpness"), F.col("embedding").cast("array<float>").alias("embedding"), at.alias("event_at"))
    rows = rows.withWatermark("event_at", f"{late_sec} seconds")
    return rows.groupBy("stream_id").transformWithStateInPandas(Shots(cfg, sel, interval_sec, idle_sec), OUT, "append", "EventTime")


def closed_picks(rows: DataFrame) -> DataFrame:
    """The picks of the closed shots among ``stream_ordered``'s rows, a row each."""
    return rows.where("kind = 'segment_closed'").select("stream_id", "segment_id", F.explode("picks").alias("p")).select("stream_id", "segment_id", "p.*")


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query whose state needs RocksDB; other queries of the session keep their store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream to the end of what has come, its rows and state below ``path``, on from where it stopped; the rows so far."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True)
    started(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


# The fields of a caption's event.
CAPTION_EVENT = ("event", "stream_id", "segment_id", "start_sec", "end_sec", "frames_sent", "text", "model", "latency_sec", "error")


def caption_events(closed: DataFrame, model, cfg: CaptionerConfig = CaptionerConfig()) -> DataFrame:
    """A caption event for each closed shot: the model is asked with the shot's time and its best picks' lines."""
    best = F.slice(F.array_sort("picks", lambda a, b: F.when(a["rank_in_segment"] < b["rank_in_segment"], -1).when(a["rank_in_segment"] > b["rank_in_segment"], 1).otherwise(0)), 1, max(1, cfg.segment_max_frames))
    rows = closed.where("kind = 'segment_closed'").withColumn("_best", F.array_sort(best, lambda a, b: F.when(a["pick_id"] < b["pick_id"], -1).when(a["pick_id"] > b["pick_id"], 1).otherwise(0)))
    rows = rows.withColumn("frames_sent", F.size("_best")).withColumn("prompt", shot_header(F.col("start_sec"), F.col("end_sec"), F.col("frames_sent")))
    lines = F.transform("_best", lambda p: part("text", F.format_string("t=%.2fs", p["timestamp_sec"])))
    rows = rows.select("stream_id", "segment_id", "start_sec", "end_sec", "frames_sent", "prompt", F.concat(F.array(part("text", F.col("prompt"))), lines).alias("content"))
    said = caption(rows, model if cfg.stream_per_segment else None, cfg, [cfg.segment_model or cfg.model, *cfg.fallback_models])
    return said.withColumn("event", F.lit("segment_caption")).select(*CAPTION_EVENT)


def caption_stream(spark: SparkSession, rows_path: str, out: str, checkpoint: str, model, cfg: CaptionerConfig = CaptionerConfig()) -> DataStreamWriter:
    """A second query, downstream of the one that writes ``stream_ordered``'s rows to ``rows_path``: it captions shots as they close.

    It reads the first query's committed files, has a checkpoint of its own, and so neither holds the first up nor loses or repeats a
    shot when either is restarted: a batch overwrites its own folder. Within a batch a stream's captions stand in order of
    their shots; batches follow one another.
    """
    rows = spark.readStream.schema(OUT).parquet(rows_path)

    def write(batch: DataFrame, number: int) -> None:
        said = caption_events(batch.repartition("stream_id"), model, cfg)
        said.sortWithinPartitions("stream_id", "segment_id").write.mode("overwrite").json(f"{out}/batch={number}")

    return rows.where("kind = 'segment_closed'").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_captions(spark: SparkSession, out: str) -> DataFrame:
    kinds = {"event": "string", "stream_id": "long", "segment_id": "int", "start_sec": "double", "end_sec": "double", "frames_sent": "int", "latency_sec": "double"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in CAPTION_EVENT)).option("recursiveFileLookup", True).json(out)


def in_batches(frames: DataFrame, batches: int, jitter_sec: float, files: int = 4) -> DataFrame:
    """A table of frames as a stream of ``batches`` arrivals, each of some files, in which frames come up to ``jitter_sec`` late.

    Frames are dealt by time plus a hash of their number. A last arrival, of a stream -1 far in the future, moves the watermark
    past all others.
    """
    spark, path = frames.sparkSession, fresh_path(frames.sparkSession)
    cols = ["stream_id", "source_idx", "timestamp_sec", "sharpness", "embedding"]
    arrives = F.col("timestamp_sec") + F.pmod(F.xxhash64("source_idx", "stream_id"), F.lit(1000)) / 1000 * jitter_sec
    frames = written(frames.select(*cols))
    lo, hi = frames.agg(F.min("timestamp_sec"), F.max("timestamp_sec")).first()
    span = ((hi or 0.0) - (lo or 0.0) + jitter_sec) or 1.0
    place = F.least(F.lit(batches - 1), F.floor((arrives - F.lit(lo or 0.0)) / span * batches).cast("int"))
    dealt = frames.select(*[F.col(c).cast("long") if c == "stream_id" else F.col(c) for c in cols], place.alias("_batch"))
    for k in range(batches):
        dealt.where(F.col("_batch") == k).drop("_batch").repartition(files, "source_idx").write.mode("append").parquet(f"{path}/in")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("stream_id"), F.lit(-1).cast("long").alias("source_idx"), F.lit((hi or 0.0) + 1e7).alias("timestamp_sec"), F.lit(0.0).alias("sharpness"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    end.write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(dealt.drop("_batch").schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
