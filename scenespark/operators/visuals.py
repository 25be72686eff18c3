"""The data behind the pictures of a run: timeline, similarity curve, film strip, contact sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import banner, colour, tick
from .joins import mark_picks
from .segment import segment_from_flags


def timeline(sampled: DataFrame) -> DataFrame:
    """A cell per frame: its shot by start flags, colour and start mark."""
    rows = segment_from_flags(sampled)
    return rows.withColumn("hue", colour(F.col("segment_from_flags")).cast("int"))


def similarity_curve(sampled: DataFrame, picks: DataFrame, threshold: float) -> DataFrame:
    """The curve's points, held between 0.5 and 1, with what lies below the threshold and what is a pick."""
    rows = mark_picks(sampled, picks)
    return rows.withColumn("y", F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col("sim_to_shot_mean")))).withColumn("below", F.col("sim_to_shot_mean") < threshold).withColumn("is_pick", F.col("pick_id").isNotNull())


def film_strip(frames: DataFrame, max_width: int = 4000, cell_width: int = 120, max_rows: int = 8) -> DataFrame:
    """Row and column of each frame; more frames than fit make the rows longer."""
    n = F.count(F.lit(1)).over(Window.partitionBy("stream_id"))
    fit = max(1, max_width // cell_width)
    per = F.when(F.ceil(n / fit) > max_rows, F.ceil(n / max_rows)).otherwise(F.lit(fit)).cast("int")
    rows = frames.withColumn("per_row", per)
    return rows.withColumn("strip_row", F.floor(F.col("analyzed_idx") / F.col("per_row")).cast("int")).withColumn("strip_col", (F.col("analyzed_idx") % F.col("per_row")).cast("int"))


def contact_sheet(picks: DataFrame, cols: int = 5) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("stream_id").orderBy("pick_id")) - 1
    rows = picks.withColumn("sheet_row", F.floor(i / cols).cast("int")).withColumn("sheet_col", (i % cols).cast("int"))
    return rows.withColumn("banner", banner(F.col("pick_id"), F.col("segment_id"), F.col("timestamp_sec")))


def labels(frames: DataFrame, ticks: int = 8) -> DataFrame:
    """The cells that carry a time label."""
    n = frames.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    at = n.withColumn("ticks", F.least(F.lit(ticks), F.col("n")).cast("int")).select("stream_id", "n", "ticks", F.explode(F.sequence(F.lit(0), F.col("ticks") - 1)).alias("label"))
    return at.select("stream_id", "label", tick(F.col("label"), F.col("n"), F.col("ticks")).alias("analyzed_idx"))


def redraws(sampled: DataFrame, every: int) -> DataFrame:
    """Frames at which a live picture is drawn anew: each ``every``-th, and each start of a shot."""
    return sampled.where((F.col("analyzed_idx") % every == 0) | F.col("is_shot_start"))
