"""The whole run: frames to shots to picks, as one plan or as a stream."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import evaluate, joins
from ..operators.captions import caption, caption_shots, prompts
from ..operators.segment import event_log, segment_frames, segment_rollup
from ..operators.select import select_picks
from ..sources import sinks
from ..sources.frames import greedy_sample
from ..store import exists, write_text, written
from ..streaming import ordered
from ..streaming.shots import stream_shots


@dataclass
class Run:
    """The tables of a run; ``sampled`` is written once, the others are plans until they are read."""

    sampled: DataFrame
    segments: DataFrame
    picks: DataFrame
    summary: DataFrame
    captions: DataFrame
    shot_captions: DataFrame


class Pipeline:
    def __init__(self, cfg: PipelineConfig = PipelineConfig()):
        self.cfg = cfg

    def run(self, frames: DataFrame, model=None, sample: bool = False, images: DataFrame | None = None) -> Run:
        """Frames with embeddings and sharpness; ``sample`` first thins them out by time; images: (path, content) for captions."""
        rows = greedy_sample(frames, self.cfg.sampler.interval_sec) if sample else frames
        sampled = written(segment_frames(rows, self.cfg.segmenter))
        segments = segment_rollup(sampled)
        picks = select_picks(sampled, self.cfg.selector)
        seen = picks if images is None else joins.with_images(picks, images)
        captions = caption(prompts(seen, self.cfg.captioner), model, self.cfg.captioner)
        return Run(sampled, segments, picks, evaluate.run_summary(sampled, picks), captions, caption_shots(seen, segments, model, self.cfg.captioner))

    def stream(self, frames: DataFrame, sample: bool = False, idle_sec: float = 0.0) -> DataFrame:
        return stream_shots(frames, self.cfg.segmenter, self.cfg.sampler.interval_sec if sample else 0.0, idle_sec)

    def follow(self, frames: DataFrame, label: str, model=None, late_sec: float = 5.0, idle_sec: float = 60.0, stop_after: float | None = None, folder: str | None = None, pace_sec: float = 1.0) -> str:
        """Follow a stream of frames until stopped (by an interrupt, or after some seconds): shots, picks and, with a model, captions as they come.

        Frames are sampled, and a batch is begun every ``pace_sec``. What has come so far stands in rows/ and captions/; at the end the shots that are still
        open are closed at their last frames, and events and picks are written as tables. Following with the ``folder`` of an earlier call goes on where that
        one stopped. Returns the folder.
        """
        spark, cfg = frames.sparkSession, self.cfg
        folder = folder or sinks.run_folder(cfg.output_root, label)
        rows = ordered.stream_ordered(frames, cfg.segmenter, cfg.selector, cfg.sampler.interval_sec, late_sec, idle_sec)
        pace = {"processingTime": f"{pace_sec} seconds"}
        writer = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(**pace)
        queries = [ordered.started(writer, spark)]
        try:
            queries[0].awaitTermination(stop_after) if stop_after else queries[0].awaitTermination()
        except KeyboardInterrupt:
            pass
        finally:
            queries[0].stop()
        if not exists(spark, f"{folder}/rows"):
            return folder
        if model:
            ordered.caption_stream(spark, f"{folder}/rows", f"{folder}/captions", f"{folder}/captioned", model, cfg.captioner).trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.schema(ordered.OUT).parquet(f"{folder}/rows")
        key = ["stream_id", "began", "segment_id"]
        closed = seen.where("kind = 'segment_closed'").select(*key, "start_sec", "end_sec", "num_frames")
        left = seen.where("kind = 'frame'").join(closed.select(*key), key, "left_anti").groupBy(*key).agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"), F.count(F.lit(1)).alias("num_frames"))
        shots = closed.unionByName(left)
        sinks.write_csv(sinks.segments_table(shots.withColumn("duration_sec", F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)))), f"{folder}/segments.csv")
        sinks.write_csv(ordered.closed_picks(seen), f"{folder}/picks.csv")
        shots.select(F.lit("segment_closed").alias("event"), "*").write.mode("overwrite").json(f"{folder}/events.jsonl")
        return folder

    def write(self, run: Run, label: str) -> str:
        """Tables, documents and, where frames name image files, copies of the picked ones and of all sampled ones; the folder."""
        spark, cfg = run.sampled.sparkSession, self.cfg
        folder = sinks.run_folder(cfg.output_root, label)
        picks, captions, shot_captions = written(run.picks), written(run.captions.drop("content")), written(run.shot_captions.drop("content"))
        sinks.write_tables(folder, run.sampled, run.segments, picks)
        sinks.write_events(event_log(run.sampled), f"{folder}/events.jsonl")
        sinks.write_json(spark, folder, "config.json", asdict(cfg))
        summary = sinks.write_rows(spark, folder, "summary", run.summary, key="streams")
        for name, rows in (("captions", captions), ("segment_captions", shot_captions)):
            rows.write.mode("overwrite").json(f"{folder}/{name}_rows")
        write_text(spark, f"{folder}/caption.md", sinks.caption_document(captions, label, cfg.embedder.name))
        write_text(spark, f"{folder}/segments.md", sinks.shot_captions_document(shot_captions))
        write_text(spark, f"{folder}/README.md", sinks.run_readme(folder, cfg, summary, run.segments, picks, captions))
        if "bgr_path" in picks.columns:
            sinks.copy_images(picks, folder, sinks.pick_path(picks))
            if cfg.cache_frames:
                sinks.copy_images(run.sampled, folder, sinks.frame_path(), cfg.cache_width)
        return folder


def compare(runs: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """runs: (run, stream_id, timestamp_sec) of picks. Each run's agreement with the first by name, stream by stream."""
    times = runs.select("run", "stream_id", F.bround("timestamp_sec", 3).alias("t"))
    first = runs.agg(F.min("run").alias("r")).first()["r"]
    return agreement(times, times.select("run", "stream_id").distinct(), "run", first, tolerance).withColumn("jaccard", F.bround("jaccard", 3))


def agreement(times: DataFrame, every: DataFrame, name: str, first, tolerance: float) -> DataFrame:
    """Each stream of each name's times (name, stream_id, t) against those that the ``first`` name has for the stream; a row for each of ``every``."""
    base = times.where(F.col(name) == F.lit(first)).select("stream_id", F.lit("a").alias("side"), "t")
    asked = every.select(name, "stream_id").join(base, "stream_id").select(name, "stream_id", "side", "t")
    own = times.select(name, "stream_id", F.lit("b").alias("side"), "t")
    return joins.match_times(asked.unionByName(own), [name, "stream_id"], tolerance, every)


def write_comparison(runs: DataFrame, folder: str, tolerance: float = 1.5) -> str:
    """``compare`` as compare.json, compare.md and, whole, compare_rows; the report's text."""
    notes = f"Agreement is of the picks' times with those of the run that is first by name, within {tolerance} s."
    return sinks.write_report(runs.sparkSession, folder, "compare", "Runs", compare(runs, tolerance), notes)


def benchmark(frames: DataFrame | dict[str, DataFrame], cfg: PipelineConfig = PipelineConfig(), tolerance: float = 1.5, first: str | None = None) -> DataFrame:
    """A row per embedder and stream: counts, and agreement of its picks' times with the first embedder's.

    frames: one table with a column ``embedder``, or a table for each name. All go through one plan, in
    which a stream is an embedder's stream.
    """
    if isinstance(frames, dict):
        first = first or next(iter(frames))
        parts = [f.withColumn("embedder", F.lit(n)) for n, f in frames.items()]
        frames = parts[0]
        for part in parts[1:]:
            frames = frames.unionByName(part, allowMissingColumns=True)
    own = F.struct("embedder", "stream_id").alias("stream_id")
    sampled = written(segment_frames(frames.select(own, *[c for c in frames.columns if c not in ("embedder", "stream_id")]), cfg.segmenter))
    keys = written(select_picks(sampled, cfg.selector))
    rows = evaluate.run_summary(sampled, keys).select("stream_id.embedder", "stream_id.stream_id", "frames", "segments", "picks", "duration_sec")
    first = first or rows.agg(F.min("embedder")).first()[0]
    times = keys.select("stream_id.embedder", "stream_id.stream_id", F.bround("timestamp_sec", 3).alias("t"))
    agree = agreement(times, rows.select("embedder", "stream_id"), "embedder", first, tolerance).select("embedder", "stream_id", F.bround("jaccard", 3).alias("jaccard"))
    return rows.join(agree, ["embedder", "stream_id"])


def with_options(cfg: PipelineConfig, **options) -> PipelineConfig:
    """Settings with options by their own names, wherever in the tree they belong."""
    for part in ("sampler", "segmenter", "selector", "captioner", "embedder"):
        own = getattr(cfg, part)
        mine = {k: v for k, v in options.items() if v is not None and k in own.__dataclass_fields__}
        cfg = replace(cfg, **{part: replace(own, **mine)})
    return replace(cfg, **{k: v for k, v in options.items() if v is not None and k in ("output_root",)})
