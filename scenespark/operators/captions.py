"""Frames for captions, prompts, and calls of an injected model with fallbacks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CaptionerConfig
from ..functions.text import RETRY_MARKS, data_url, prompt_line, shot_header


def cap_subset(picks: DataFrame, most: int) -> DataFrame:
    """At most ``most`` picks of each stream, evenly spaced in time order, and how many (of)."""
    stream = Window.partitionBy("stream_id")
    rows = picks.withColumn("_i", F.row_number().over(stream.orderBy("timestamp_sec", "pick_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(stream))
    step = (F.col("_n") - 1) / F.lit(max(most - 1, 1))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * step).cast("int")))
    kept = rows.where((F.col("_n") <= most) | F.array_contains(places, F.col("_i").cast("int")))
    return kept.withColumn("of", F.count(F.lit(1)).over(stream)).drop("_i", "_n")


def shot_subset(picks: DataFrame, most: int) -> DataFrame:
    """The best ``most`` picks of each shot, and their place in time order."""
    shot = Window.partitionBy("stream_id", "segment_id")
    best = picks.withColumn("_r", F.row_number().over(shot.orderBy(F.desc("composite_score"), "timestamp_sec"))).where(F.col("_r") <= max(1, most)).drop("_r")
    return best.withColumn("place", (F.row_number().over(shot.orderBy("timestamp_sec")) - 1).cast("int"))


def prompt_lines(picks: DataFrame, cfg: CaptionerConfig = CaptionerConfig()) -> DataFrame:
    rows = cap_subset(picks, cfg.max_picks)
    return rows.withColumn("line", prompt_line(F.col("pick_id"), F.col("of"), F.col("timestamp_sec"), F.col("segment_id")))


def part(kind: str, text: Column, detail: str = "") -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("value"), F.lit(detail).alias("detail"))


def contents(header: Column, rows: str, cfg: CaptionerConfig, lines: bool) -> Column:
    """A header, then for each frame its line and, where it has one, its image as a data URL."""
    def of(r):
        image = F.when(r["image"].isNotNull(), F.array(part("image", data_url(r["image"]), cfg.detail))).otherwise(F.array().cast("array<struct<type:string,value:string,detail:string>>"))
        return F.concat(F.array(part("text", r["line"])), image) if lines else image

    return F.concat(F.array(part("text", header)), F.flatten(F.transform(rows, of)))


def prompts(picks: DataFrame, cfg: CaptionerConfig = CaptionerConfig()) -> DataFrame:
    """One prompt per stream: its lines in time order, and the same with a header and the frames' images (column ``image``, bytes)."""
    rows = prompt_lines(picks, cfg)
    rows = rows if "image" in rows.columns else rows.withColumn("image", F.lit(None).cast("binary"))
    got = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_sec", "pick_id", "line", "image"))).alias("x"), (F.max("timestamp_sec") - F.min("timestamp_sec")).alias("span"))
    header = F.format_string("%d frames of one video of about %.1f s follow in time order.", F.size("x"), F.col("span"))
    return got.select("stream_id", F.size("x").alias("frames_sent"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("prompt"), contents(header, "x", cfg, True).alias("content"))


def shot_prompts(picks: DataFrame, segments: DataFrame, cfg: CaptionerConfig = CaptionerConfig()) -> DataFrame:
    """One prompt per shot: when it was, and its best frames in time order."""
    rows = shot_subset(picks, cfg.segment_max_frames)
    rows = rows if "image" in rows.columns else rows.withColumn("image", F.lit(None).cast("binary"))
    got = rows.groupBy("stream_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_sec", "place", "image"))).alias("x"))
    every = segments.select("stream_id", "segment_id", "start_sec", "end_sec").join(got, ["stream_id", "segment_id"])
    header = shot_header(F.col("start_sec"), F.col("end_sec"), F.size("x"))
    return every.select("stream_id", "segment_id", "start_sec", "end_sec", F.size("x").alias("frames_sent"), header.alias("prompt"), contents(header, "x", cfg, False).alias("content"))


def caption_shots(picks: DataFrame, segments: DataFrame, model, cfg: CaptionerConfig = CaptionerConfig()) -> DataFrame:
    """A sentence for each shot, by the shots' own model where one is named."""
    return caption(shot_prompts(picks, segments, cfg), model if cfg.stream_per_segment else None, cfg, [cfg.segment_model or cfg.model, *cfg.fallback_models])


def call_models(prompt, models: list[str], model: Callable[[str, object], str]) -> tuple[str, str, str]:
    """(text, model, error): the next model is asked only after errors that look regional or of access."""
    error = ""
    for name in models:
        try:
            return model(name, prompt), name, ""
        except Exception as e:  # noqa: BLE001  any failure of an injected call becomes a row
            error = str(e)
            if not any(m in error for m in RETRY_MARKS):
                return "", name, error
    return "", models[-1] if models else "", error


def caption(rows: DataFrame, model: Callable[[str, object], str] | None, cfg: CaptionerConfig = CaptionerConfig(), models: list[str] | None = None, each: Column | None = None) -> DataFrame:
    """Rows with a prompt get text, model, latency_sec and error; without a model, a remark instead.

    A model is called with its name and the prompt, or, if it says ``wants_content``, the list of the prompt's parts.
    ``each``: a column with the one model that a row asks.
    """
    if model is None or not cfg.enabled:
        return rows.select("*", F.lit("(captioning disabled)").alias("text"), F.lit("").alias("model"), F.lit(0.0).alias("latency_sec"), F.lit("").alias("error"))
    names = models or [cfg.model, *cfg.fallback_models]
    rich = bool(getattr(model, "wants_content", False)) and "content" in rows.columns
    asks = F.to_json("content") if rich else F.col("prompt")

    @F.pandas_udf("text string, model string, latency_sec double, error string")
    def run(prompt: pd.Series, only: pd.Series) -> pd.DataFrame:
        out = []
        for p, name in zip(prompt, only, strict=True):
            t = time.perf_counter()
            text, used, error = call_models(json.loads(p) if rich else p, [name] if name else names, model)
            out.append((text, used, time.perf_counter() - t, error))
        return pd.DataFrame(out, columns=["text", "model", "latency_sec", "error"])

    return rows.withColumn("_c", run(asks, F.lit("") if each is None else each)).select(*rows.columns, "_c.*")


def compare_models(rows: DataFrame, names: list[str], model: Callable[[str, object], str]) -> DataFrame:
    """Each prompt with each model, without fallbacks; a failure is a row with its error. One plan for all models."""
    every = rows.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("asked"))
    return caption(every, model, CaptionerConfig(), each=F.col("asked")).drop("asked")
