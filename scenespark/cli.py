"""Command line: run, list-embedders, benchmark, caption-bench."""

from __future__ import annotations

import argparse
import importlib

from .config import PipelineConfig
from .functions.embedders import list_embedders

OPTIONS = {
    "--sample-interval": ("interval_sec", float),
    "--sim-threshold": ("sim_threshold", float),
    "--min-shot-sec": ("min_shot_sec", float),
    "--ema-alpha": ("ema_alpha", float),
    "--max-per-segment": ("max_frames_per_segment", int),
    "--seconds-per-pick": ("seconds_per_pick", float),
    "--min-spacing-sec": ("min_temporal_spacing_sec", float),
    "--sharpness-weight": ("sharpness_weight", float),
    "--repr-weight": ("representativeness_weight", float),
    "--diversity-threshold": ("diversity_sim_threshold", float),
    "--min-picks": ("min_picks", int),
    "--model": ("model", str),
    "--detail": ("detail", str),
    "--max-caption-frames": ("max_picks", int),
    "--device": ("device", str),
    "--output-root": ("output_root", str),
}


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scenespark", description="Shots and picks of ordered frames, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list-embedders", help="names of the registered embedders")
    for name in ("run", "benchmark", "caption-bench"):
        p = commands.add_parser(name)
        p.add_argument("source", help="a folder of images, or a Parquet table of frames")
        for flag, (dest, kind) in OPTIONS.items():
            p.add_argument(flag, dest=dest, type=kind, default=None)
        p.add_argument("--no-ema", dest="use_ema", action="store_false", default=None)
        p.add_argument("--no-caption", dest="enabled", action="store_false", default=None)
        p.add_argument("--fps", type=float, default=0.0, help="rate of a folder's frames, which are then read on the grid of the interval")
        p.add_argument("--start", type=float, default=None, help="leave out frames before this second")
        p.add_argument("--end", type=float, default=None, help="leave out frames from this second on")
        p.add_argument("--workers", type=int, default=8, help="stretches of a folder that are read side by side")
        p.add_argument("--realtime", action="store_true", help="follow the source until stopped")
        p.add_argument("--frames-per-batch", type=int, default=30, help="of each stream, with --realtime")
        p.add_argument("--late-sec", type=float, default=5.0, help="how late a frame may come, with --realtime")
        p.add_argument("--idle-sec", type=float, default=60.0, help="after so long without frames a stream has ended, with --realtime")
        p.add_argument("--stop-after", type=float, default=None, help="seconds after which a followed source is left")
        p.add_argument("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
        if name == "benchmark":
            p.add_argument("--embedders", nargs="+", default=["phash", "hsv"])
        else:
            p.add_argument("--embedder", dest="name", default="phash", choices=list_embedders())
        if name != "benchmark":
            p.add_argument("--caller", default=None, help="module:function that is called with a model's name and a prompt")
        if name == "caption-bench":
            p.add_argument("--models", nargs="+", required=True)
    return top


def called(spec: str | None):
    """The function that ``module:function`` names, or None."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def config_of(args: argparse.Namespace) -> PipelineConfig:
    from .plans.pipeline import with_options

    return with_options(PipelineConfig(), **vars(args))


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "list-embedders":
        print("\n".join(list_embedders()))
        return 0
    from pyspark.sql import SparkSession

    from .config import load_dotenv, resolve_device
    from .operators.captions import compare_models, prompts
    from .plans.pipeline import Pipeline, benchmark
    from .sources import sinks
    from .sources.frames import is_table, open_source, sample
    from .streaming.shots import Progress

    load_dotenv(".env")
    spark = SparkSession.builder.appName("scenespark").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR" if args.log_level == "ERROR" else "WARN")
    cfg = config_of(args)
    model = called(getattr(args, "caller", None))
    pipeline = Pipeline(cfg)
    label = args.source.rstrip("/").rpartition("/")[2] or "run"

    def frames(embedder: str, realtime: bool = False):
        return open_source(spark, args.source, realtime, embedder, cfg.sampler.interval_sec, args.frames_per_batch, resolve_device(cfg.embedder.device), cfg.embed_max_width, args.fps, args.start, args.end, args.workers)

    if args.command == "benchmark":
        if is_table(args.source):
            table = frames("")
            if "embedder" not in table.columns:
                raise SystemExit("a benchmark needs images to embed, or a table of frames with a column embedder")
            by_name = {n: table.where(table["embedder"] == n).drop("embedder") for n in args.embedders}
        else:
            by_name = {n: frames(n) for n in args.embedders}
        folder = sinks.run_folder(cfg.output_root, "benchmark")
        rows = benchmark({n: sample(f, cfg.sampler.interval_sec) for n, f in by_name.items()}, cfg)
        print(sinks.write_report(spark, folder, "benchmark", "Embedders", rows, "Agreement is of the picks' times with the first embedder's, within 1.5 s."))
    elif args.command == "caption-bench":
        if model is None:
            raise SystemExit("caption-bench needs --caller module:function")
        run = pipeline.run(sample(frames(args.name), cfg.sampler.interval_sec))
        folder = sinks.run_folder(cfg.output_root, "caption_bench")
        print(sinks.write_report(spark, folder, "caption_bench", "Models", compare_models(prompts(run.picks, cfg.captioner), args.models, model).drop("content")))
    elif args.realtime:
        listener = Progress(lambda event: print(event, flush=True))
        spark.streams.addListener(listener)
        try:
            print(pipeline.follow(frames(args.name, True), label, model, args.late_sec, args.idle_sec, args.stop_after))
        finally:
            spark.streams.removeListener(listener)
    else:
        print(pipeline.write(pipeline.run(sample(frames(args.name), cfg.sampler.interval_sec), model), label))
    return 0
