"""Sampling, images, histories, sinks and streams."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.config import PipelineConfig, SegmenterConfig, load_dotenv, resolve_device
from scenespark.functions import embedders, images
from scenespark.functions import png as png_codec
from scenespark.plans import queries
from scenespark.plans.pipeline import Pipeline, benchmark, with_options
from scenespark.sources import frames as src
from scenespark.sources import sinks
from scenespark.store import read_text
from scenespark.streaming import shots

from .conftest import DATA


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def timed(spark, times, stream=1):
    return spark.createDataFrame([(stream, k, float(t)) for k, t in enumerate(times)], "stream_id long, source_idx long, timestamp_sec double")


def test_greedy_counts_from_the_last_kept(spark):
    out = src.greedy_sample(timed(spark, [0, 0.6, 1.2, 1.9, 2.2, 3.4]), 1.0).orderBy("timestamp_sec").collect()
    assert [r["timestamp_sec"] for r in out] == [0.0, 1.2, 2.2, 3.4]


def test_grid_takes_the_nearest_frame(spark):
    out = src.grid_sample(timed(spark, range(10)), 1.0, 4.0).orderBy("analyzed_idx").collect()
    assert [(r["analyzed_idx"], r["timestamp_sec"], r["source_idx"]) for r in out] == [(0, 0.0, 0), (1, 1.0, 4), (2, 2.0, 8)]
    with pytest.raises(ValueError):
        src.grid_sample(timed(spark, [0]), 0.0, 4.0)


def test_slots_and_chunks(spark):
    out = src.slot_dedup(timed(spark, [0.1, 0.4, 0.6, 1.4, 1.6]), 1.0).orderBy("slot").collect()
    assert [(r["slot"], r["source_idx"]) for r in out] == [(0, 0), (1, 2), (2, 4)]
    got = timed(spark, [0, 2.4, 2.6, 9.9]).select(src.chunk_of(F.col("timestamp_sec"), F.lit(10.0), 4, 1.0).alias("c")).collect()
    assert [r["c"] for r in got] == [0, 1, 1, 3]


def test_specs_and_backends(spark):
    assert src.sampled_source(spark, "", None) == ("camera", "0") and src.sampled_source(spark, "2") == ("camera", "2")
    assert src.sampled_source(spark, "rtsp://x/y")[0] == "url" and src.sampled_source(spark, "", "up.mp4") == ("file", "up.mp4") and src.sampled_source(spark, "a.mp4", "b.mp4") == ("file", "a.mp4")
    assert [src.pick_backend(*x) for x in (("file", False), ("file", True), ("url", False), ("file", False, 4, True), ("file", False, 1, True))] == ["scan", "stream", "stream", "parallel", "decoder"]


def test_probe_rules(spark):
    meta = [
        {"streams": [{"width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "duration": "10", "nb_frames": "299", "side_data_list": [{"rotation": -90}]}], "format": {"duration": "11"}},
        {"streams": [{"width": 640, "height": 480, "avg_frame_rate": "0/0", "r_frame_rate": "25/1", "tags": {"rotate": "90"}}], "format": {"duration": "4"}},
    ]
    rows = src.probe(spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(meta)], "k int, meta string")).orderBy("k").collect()
    assert [(r["width"], round(r["fps"], 3), r["duration_sec"], r["frame_count"], r["rotation"]) for r in rows] == [(1920, 29.97, 10.0, 299, 90), (640, 25.0, 4.0, 100, 270)]


def test_kernels():
    flat, edge = np.full((64, 64, 3), 128, np.uint8), np.full((64, 64, 3), 128, np.uint8)
    edge[:, 32:] = 0
    assert images.sharpness(flat) == 0 < images.sharpness(edge)
    assert images.resize_max_width(np.zeros((100, 400, 3), np.uint8), 200).shape == (50, 200, 3) and images.resize_max_width(flat, 200) is flat
    noise = np.random.default_rng(0).integers(0, 256, (32, 48, 3), dtype=np.uint8)
    bits = images.phash(noise)
    assert bits.shape == (64,) and set(bits) <= {0.0, 1.0}
    h = images.hsv_histogram(noise)
    assert h.shape == (96,) and np.allclose(h.reshape(3, 32).sum(1), 1)
    assert images.hsv(np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0]]], np.uint8))[0, :, 0].tolist() == [0, 60, 120]


def test_registry():
    assert {"phash", "hsv"} <= set(embedders.list_embedders()) and len(embedders.list_embedders()) == 18
    with pytest.raises(KeyError):
        embedders.build_embedder("none")
    with pytest.raises(RuntimeError):
        embedders.build_embedder("yolov8n")
    x = [np.random.default_rng(k).integers(0, 256, (16, 16, 3), dtype=np.uint8) for k in range(3)]
    model = embedders.build_embedder("hsv")
    assert all((a == model.embed(b)).all() for a, b in zip(model.embed_batch(x), x)) and model.info().dim == 96
    assert embedders.microbenchmark("phash", x[0], 1, 3)["fps"] > 0


def sees(name, content):
    return f"{name}: " + ",".join(p["type"] for p in content)


sees.wants_content = True


def test_image_folder_to_picks(spark, tmp_path):
    rng = np.random.default_rng(1)
    scenes = [rng.integers(0, 256, (24, 32, 3), dtype=np.uint8) for _ in range(2)]
    for k in range(8):
        png(tmp_path / f"f{k:03d}.png", scenes[k // 4])
    (tmp_path / "broken.png").write_bytes(b"no image")
    f = src.frames_from_images(spark, str(tmp_path), "hsv")
    assert f.count() == 8
    run = Pipeline(with_options(PipelineConfig(), sim_threshold=0.99, min_shot_sec=1.0, output_root=str(tmp_path / "out"))).run(f)
    assert run.segments.count() == 2 and run.summary.first()["frames"] == 8
    folder = Pipeline(PipelineConfig(output_root=str(tmp_path / "out"), cache_width=16)).write(run, "my run/1")
    back = src.read_picks(spark, f"{folder}/picks.csv")
    want = [(r["pick_id"], r["segment_id"], r["timestamp_sec"], r["rank_in_segment"]) for r in run.picks.orderBy("pick_id").collect()]
    assert "my_run_1" in folder and back.columns == src.PICK_CSV.names
    assert [(r["pick_id"], r["segment_id"], r["timestamp_sec"], r["rank_in_segment"]) for r in back.collect()] == want
    over = src.load_run(spark, folder).first()
    assert src.run_history(spark, str(tmp_path / "out")).count() == 1 and (over["frames"], over["segments"], over["picks"]) == (8, 2, len(want))
    assert "## Shots" in read_text(spark, f"{folder}/README.md") and "disabled" in read_text(spark, f"{folder}/caption.md") and "# Captions of shots" in read_text(spark, f"{folder}/segments.md")
    for r in back.collect():
        assert r["saved_path"].startswith("picks/0/kf_") and open(f"{folder}/{r['saved_path']}", "rb").read(4) == b"\x89PNG"  # noqa: SIM115
    assert len(os.listdir(f"{folder}/picks/0")) == len(want) and len(os.listdir(f"{folder}/frames/0")) == 8
    small = f"{folder}/frames/0/{sorted(os.listdir(f'{folder}/frames/0'))[0]}"
    with open(small, "rb") as image:
        assert png_codec.decode(image.read()).shape == (12, 16, 3)
    summary = json.loads(read_text(spark, f"{folder}/summary.json"))
    assert (summary["shown"], summary["of"]) == (1, 1) and spark.read.json(f"{folder}/summary_rows").count() == 1
    seen = Pipeline(PipelineConfig()).run(f, model=sees, images=spark.read.format("binaryFile").load(str(tmp_path / "*.png")))
    assert all(r["text"].startswith("default: text,text,image") for r in seen.captions.collect()) and seen.shot_captions.count() == seen.segments.count()
    assert "| frames |" in sinks.markdown("T", run.summary.select("frames"))
    assert "2 of 8 rows are shown; all of them are in `x`." in sinks.markdown("T", run.sampled.select("source_idx"), 2, "x")
    two = benchmark({"hsv": f, "phash": src.frames_from_images(spark, str(tmp_path), "phash")})
    assert {r["embedder"]: r["jaccard"] for r in two.collect()}["hsv"] == 1.0


def test_dotenv_and_device(tmp_path, monkeypatch):
    monkeypatch.setenv("KEPT_KEY", "old")
    monkeypatch.delenv("NEW_KEY", raising=False)
    (tmp_path / ".env").write_text("# note\nNEW_KEY=\"a b\"\nKEPT_KEY=new\nEMPTY=\nno equals\n")
    load_dotenv(tmp_path / ".env")
    assert os.environ["NEW_KEY"] == "a b" and os.environ["KEPT_KEY"] == "old" and load_dotenv(tmp_path / "none") == {}
    assert resolve_device("auto") == "cpu" and resolve_device("cuda") == "cuda"


def test_stream_in_pieces_equals_one_batch(spark, tmp_path):
    """Frames that come in several files, with a late row, give the shots of a batch."""
    rng = np.random.default_rng(2)
    rows = [(k % 3, k, float(k // 3), rng.normal(size=4).astype(float).tolist()) for k in range(90)]
    schema = "stream_id int, source_idx long, timestamp_sec double, embedding array<double>"
    cfg = SegmenterConfig(sim_threshold=0.2, min_shot_sec=2.0)
    for k in range(3):
        part = rows[30 * k : 30 * k + 30] + ([(0, 999, 1.0, [1.0, 0.0, 0.0, 0.0])] if k == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = shots.two_sinks(shots.stream_shots(stream, cfg), f"{tmp_path}/frames", f"{tmp_path}/events", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/frames")
    from scenespark.operators.segment import event_log, segment_frames

    batch = segment_frames(spark.createDataFrame(rows, schema).withColumn("sharpness", F.lit(1.0)), cfg)
    key = ["stream_id", "source_idx", "segment_id", "is_shot_start"]
    assert sorted(got.withColumn("stream_id", F.col("stream_id").cast("int")).select(*key).collect()) == sorted(batch.select(*key).collect())
    assert spark.read.json(f"{tmp_path}/events").count() == event_log(batch).count()


class State:
    """What a stream's state offers, in memory."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_stream_closes_its_open_shot():
    import pandas as pd

    state, cfg = State(), SegmenterConfig(sim_threshold=0.9, min_shot_sec=0.0)
    rows = pd.DataFrame({"source_idx": [0, 1, 2], "timestamp_sec": [0.0, 1.0, 2.0], "embedding": [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]})
    out = pd.concat(shots.shot_rows((7,), iter([rows]), state, cfg, 0.0, 30.0))
    assert list(out["kind"]) == ["frame", "frame", "segment_closed", "frame"] and state.timeout == 30_000
    state.hasTimedOut = True
    last = pd.concat(shots.shot_rows((7,), iter([]), state, cfg, 0.0, 30.0))
    assert [tuple(r) for r in last[["kind", "segment_id", "start_sec", "end_sec", "num_frames"]].values] == [("segment_closed", 1, 2.0, 2.0, 1)] and not state.exists


def test_progress_and_restarts(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    told, starts = [], []
    listener = shots.Progress(told.append)
    spark.streams.addListener(listener)

    def start():
        starts.append(1)
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        if len(starts) == 1:
            rows = rows.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
        return rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    shots.restarted(start, 3, 0.0)
    assert len(starts) == 2 and spark.read.parquet(f"{tmp_path}/out").count() == 10
    for _ in range(50):
        if sum(e["stage"] == "done" for e in told) == 2:
            break
        import time

        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert {e["stage"] for e in told} == {"init", "frame", "done"}


def test_command_line_runs(spark, tmp_path, capsys):
    from scenespark.cli import main

    rng = np.random.default_rng(3)
    rows = [(0, k, k, float(k), rng.normal(size=8).tolist(), 1.0 * k) for k in range(30)]
    spark.createDataFrame(rows, "stream_id int, source_idx long, analyzed_idx int, timestamp_sec double, embedding array<double>, sharpness double").coalesce(1).write.parquet(f"{tmp_path}/f.parquet")
    common = ["--sim-threshold", "0.1", "--output-root", f"{tmp_path}/out"]
    assert main(["run", f"{tmp_path}/f.parquet", *common]) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    assert src.load_run(spark, folder).first()["frames"] == 30
    with pytest.raises(SystemExit):
        main(["benchmark", f"{tmp_path}/f.parquet", *common])
    assert main(["caption-bench", f"{tmp_path}/f.parquet", *common, "--models", "a", "b", "--caller", "tests.test_sources_streams:answer"]) == 0
    assert "a says" in capsys.readouterr().out


def test_overview_of_a_broken_run(spark, tmp_path):
    """Tables and summaries that are missing, or know other streams, take nothing away."""
    assert src.load_run(spark, f"{tmp_path}/none").count() == 0
    sinks.write_csv(spark.createDataFrame([(1, 0.0), (1, 2.5), (2, 1.0)], "stream_id int, timestamp_sec double"), f"{tmp_path}/a/analyzed_frames.csv")
    (tmp_path / "a" / "summary.json").write_text(json.dumps({"streams": [{"stream_id": 7, "frames": 5, "segments": 2, "picks": 1, "duration_sec": 3.0}]}))
    got = {r["stream_id"]: (r["frames"], r["segments"], r["picks"], r["duration_sec"]) for r in src.load_run(spark, f"{tmp_path}/a").collect()}
    assert got == {1: (2, 0, 0, 2.5), 2: (1, 0, 0, 0.0), 7: (5, 2, 1, 3.0)}


def test_comparison_is_written(spark, tmp_path):
    from scenespark.plans.pipeline import write_comparison

    rows = [("a", s, float(s)) for s in range(250)] + [("b", s, s + 1.0) for s in range(250)]
    text = write_comparison(spark.createDataFrame(rows, "run string, stream_id int, timestamp_sec double"), f"{tmp_path}/c")
    assert "200 of 500 rows are shown" in text and spark.read.json(f"{tmp_path}/c/compare_rows").count() == 500
    assert json.loads((tmp_path / "c" / "compare.json").read_text())["of"] == 500


def test_cluster_of_processes_needs_a_named_folder():
    from types import SimpleNamespace

    from scenespark.store import shared_folder

    def session(master):
        sc = SimpleNamespace(getCheckpointDir=lambda: None, master=master, getConf=lambda: SimpleNamespace(get=lambda name: None), setCheckpointDir=lambda path: None)
        return SimpleNamespace(sparkContext=sc)

    for master in ("local-cluster[2,1,1024]", "spark://x:7077"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
    shared_folder(session("local[2]"))


def answer(name, prompt):
    return f"{name} says {len(prompt)}"


def test_compare_runs(spark):
    from scenespark.plans.pipeline import compare

    rows = [("a", 1, 0.0), ("a", 1, 5.0), ("b", 1, 1.0), ("b", 1, 9.0), ("b", 2, 3.0)]
    got = {(r["run"], r["stream_id"]): r["jaccard"] for r in compare(spark.createDataFrame(rows, "run string, stream_id int, timestamp_sec double")).collect()}
    assert got == {("a", 1): 1.0, ("b", 1): 0.333, ("b", 2): 0.0}


def foldered(spark, tmp_path, name):
    """A folder of tables in which one is a folder of several files."""
    spark.read.parquet(f"{DATA}/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_frames_stream_from_a_table_of_several_files(spark, tmp_path):
    got = queries.streaming_frames(spark, foldered(spark, tmp_path, "embeddings")).collect()
    assert got and sorted(got) == sorted(queries.segment_frames_ema(spark, f"{DATA}/sf0.001").collect())


def test_shots_stream_from_a_table_of_several_files(spark, tmp_path):
    got = queries.streaming_segments(spark, foldered(spark, tmp_path, "embeddings")).collect()
    want = queries.segment_rollup(spark, f"{DATA}/sf0.001").select("stream_id", "segment_id", "start_sec", "end_sec", "num_frames").collect()
    assert got and sorted(got) == sorted(want)
