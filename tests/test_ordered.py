"""Streams by event time: late rows, picks at a shot's close, dead streams, captions downstream, restarts."""

import json
import os
import threading

import numpy as np
from pyspark.sql import functions as F

from scenespark.config import CaptionerConfig, SegmenterConfig, SelectorConfig
from scenespark.functions import png
from scenespark.operators.segment import segment_frames, segment_rollup
from scenespark.operators.select import select_picks
from scenespark.store import written
from scenespark.streaming import ordered

SEG = SegmenterConfig(sim_threshold=0.2, min_shot_sec=2.0)
SEL = SelectorConfig(max_frames_per_segment=3, seconds_per_pick=3.0, min_temporal_spacing_sec=1.5)
SCHEMA = "stream_id long, source_idx long, timestamp_sec double, sharpness double, embedding array<double>"


def frames(n=240, streams=3, seed=2):
    rng = np.random.default_rng(seed)
    return [(k % streams, k, float(k // streams), float(rng.random() * 9), rng.normal(size=4).round(3).tolist()) for k in range(n)]


def test_shuffled_arrivals_equal_the_batch(spark):
    """Frames up to nine seconds late, over five batches: shots and picks are the batch's, and dead streams have left no state."""
    table = spark.createDataFrame(frames(), SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = ordered.drained(ordered.stream_ordered(ordered.in_batches(table, 5, 9.0, 2), SEG, SEL, late_sec=10.0, idle_sec=30.0), f"{ordered.fresh_path(spark)}")
    sampled = written(segment_frames(table, SEG))
    key = ["stream_id", "source_idx", "segment_id", "is_shot_start"]
    assert sorted(rows.where("kind = 'frame'").select(*key).collect()) == sorted(sampled.select(*key).collect())
    shot = ["stream_id", "segment_id", "start_sec", "end_sec", "num_frames"]
    closed = rows.where("kind = 'segment_closed'")
    assert sorted(closed.select(*shot).collect()) == sorted(segment_rollup(sampled).select(*shot).collect())
    assert {r["stream_id"]: r["n"] for r in closed.where("closed_by = 'idle'").groupBy("stream_id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 1, 2: 1}
    pick = ["stream_id", "pick_id", "segment_id", "source_idx"]
    assert sorted(ordered.closed_picks(rows).select(*pick).collect()) == sorted(select_picks(sampled, SEL, diverse=False).select(*pick).collect())


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_restarts_idle_streams_and_captions(spark, tmp_path):
    """A query that stops and starts again goes on; a stream that was silent begins anew; each shot is captioned once."""
    calm, other = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    at = lambda s, t, e: (s, int(t * 10), float(t), 1.0, e)
    steps = [
        [at(1, 1, calm), at(1, 0, calm), at(1, 2, calm), at(2, 0, calm)],
        [at(1, 5, other), at(1, 3, calm), at(1, 4, calm)],
        [at(1, 60, calm), at(1, 61, calm), at(1, 0.5, other)],  # the last one is later than the watermark and dropped
        [at(3, 200, calm)],
    ]

    def go():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ordered.drained(ordered.stream_ordered(stream, SEG, SEL, late_sec=4.0, idle_sec=20.0), f"{tmp_path}/run")
        ordered.caption_stream(spark, f"{tmp_path}/run/rows", f"{tmp_path}/captions", f"{tmp_path}/said", lambda name, prompt: prompt[:30], CaptionerConfig()).trigger(availableNow=True).start().awaitTermination()

    for rows in steps:
        arrive(spark, f"{tmp_path}/in", rows)
        go()
    go()
    rows = spark.read.schema(ordered.OUT).parquet(f"{tmp_path}/run/rows")
    closed = sorted(tuple(r) for r in rows.where("kind = 'segment_closed'").select("stream_id", "began", "segment_id", "start_sec", "end_sec", "num_frames", "closed_by").collect())
    assert closed == [(1, 0.0, 0, 0.0, 5.0, 5, "cut"), (1, 0.0, 1, 5.0, 5.0, 1, "idle"), (1, 60.0, 0, 60.0, 61.0, 2, "idle"), (2, 0.0, 0, 0.0, 0.0, 1, "idle")]
    seen = sorted((r["stream_id"], r["timestamp_sec"]) for r in rows.where("kind = 'frame'").collect())
    assert seen == [(1, t) for t in (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 60.0, 61.0)] + [(2, 0.0)]
    said = ordered.read_captions(spark, f"{tmp_path}/captions").collect()
    assert sorted((r["stream_id"], r["start_sec"], r["end_sec"]) for r in said) == sorted((c[0], c[3], c[4]) for c in closed)
    assert all(r["event"] == "segment_caption" and r["text"].startswith("Shot starting at") and r["error"] == "" for r in said)


def test_captions_stand_in_order(spark, tmp_path):
    table = spark.createDataFrame(frames(120, 2), SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    path = f"{tmp_path}/run"
    ordered.drained(ordered.stream_ordered(ordered.in_batches(table, 2, 1.0, 1), SEG, SEL, late_sec=2.0, idle_sec=30.0), path)
    ordered.caption_stream(spark, f"{path}/rows", f"{tmp_path}/captions", f"{tmp_path}/said", lambda name, prompt: "x").trigger(availableNow=True).start().awaitTermination()
    for folder, _, names in os.walk(tmp_path / "captions"):
        for n in names:
            if n.endswith(".json"):
                with open(f"{folder}/{n}") as f:
                    keys = [(r["stream_id"], r["segment_id"]) for r in map(json.loads, f)]
                assert keys == sorted(keys)


def test_picks_of_a_shot_alone():
    rows = [(k, float(k), float(k % 3), [1.0, 0.0]) for k in range(6)]
    total = np.array([6.0, 0.0])
    got = ordered.picks_of_shot(rows, total, 0.0, 6.0, SelectorConfig(max_frames_per_segment=2, seconds_per_pick=1.0, min_temporal_spacing_sec=2.0), 4)
    assert [(p["pick_id"], p["source_idx"], p["rank_in_segment"]) for p in got] == [(5, 2, 0), (6, 5, 1)]
    alone = ordered.picks_of_shot(rows[:1], np.array([1.0, 0.0]), 0.0, 0.0, SelectorConfig(), 0)
    assert [(p["pick_id"], p["composite_score"], p["representativeness"]) for p in alone] == [(1, 0.0, 1.0)]


def test_command_line_follows_a_folder(spark, tmp_path, capsys):
    """Frames come while the source is followed; each ends up in one shot, and the picks' files can be opened."""
    from scenespark.cli import main

    rng = np.random.default_rng(1)
    scenes = [rng.integers(0, 100, (24, 32, 3), dtype=np.uint8) + np.array(c, np.uint8) for c in ((150, 0, 0), (0, 60, 150))]
    live = tmp_path / "live"
    live.mkdir()

    def put(a, b):
        for k in range(a, b):
            (live / f".{k:03d}.png").write_bytes(png.encode(scenes[k // 6]))
            os.rename(live / f".{k:03d}.png", live / f"{k:03d}.png")

    put(0, 5)
    later = threading.Timer(6.0, lambda: put(5, 12))
    later.start()
    args = ["run", str(live), "--realtime", "--fps", "1", "--embedder", "hsv", "--sim-threshold", "0.9", "--min-shot-sec", "1", "--late-sec", "0", "--output-root", f"{tmp_path}/out", "--stop-after", "25"]
    assert main(args) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    rows = spark.read.schema(ordered.OUT).parquet(f"{folder}/rows")
    assert sorted(r["timestamp_sec"] for r in rows.where("kind = 'frame'").collect()) == [float(k) for k in range(12)]
    shots = [(r["segment_id"], r["start_sec"], r["end_sec"]) for r in spark.read.csv(f"{folder}/segments.csv", header=True, inferSchema=True).orderBy("segment_id").collect()]
    assert shots == [(0, 0.0, 6.0), (1, 6.0, 11.0)]



def test_shots_that_close_in_one_call_stay_out_of_the_store():
    class Kept:
        def __init__(self):
            self.rows, self.calls = None, 0

        def exists(self):
            return self.rows is not None

        def get(self):
            self.calls += 1
            return self.rows or ()

        def appendList(self, rows):
            self.calls += 1
            self.rows = [*(self.rows or []), *rows]

        def update(self, row):
            self.rows = row

        put = update

        def clear(self):
            self.rows = None

    class Handle:
        def getListState(self, *_):
            return Kept()

        getValueState = getListState

        def registerTimer(self, at):
            pass

        deleteTimer = registerTimer

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10**9

    p = ordered.Shots(SegmenterConfig(sim_threshold=0.5, min_shot_sec=0.0), SelectorConfig(), 0.0, 0.0)
    p.init(Handle())
    turned = [[1.0, 0.0], [0.0, 1.0]]
    found = []
    for at in (0, 100):  # the shot left open by the first call goes on in the second
        p.waiting.rows = [(k, float(k), 1.0, turned[k // 2 % 2]) for k in range(at, at + 100)]
        out = next(p.handleExpiredTimer((1,), Now(), None))
        found.append(out[out["kind"] == "segment_closed"])
    assert [len(x) for x in found] == [49, 50]
    assert all((x["num_frames"] == 2).all() for x in found) and found[1]["start_sec"].iloc[0] == 98.0
    assert [q["source_idx"] for q in found[1]["picks"].iloc[0]] and {q["source_idx"] for q in found[1]["picks"].iloc[0]} <= {98, 99}
    assert p.frames.calls <= 3
