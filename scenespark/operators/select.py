"""Chosen frames: scores within shots, well-spaced picks, and diversity across a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SelectorConfig
from ..functions.text import target_k
from ..functions.vectors import cosine, zscore
from ..store import checkpoint
from .folds import fold
from .prefix import in_order

SHOT = ["stream_id", "segment_id"]


def centroids(sampled: DataFrame) -> DataFrame:
    """(stream_id, segment_id, centroid): mean embedding, summed per dimension with partial sums."""
    parts = sampled.select(*SHOT, F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    mean = parts.groupBy(*SHOT, "dim").agg(F.avg("v").alias("v"))
    return mean.groupBy(*SHOT).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("c")).select(*SHOT, F.transform("c", lambda x: x["v"]).alias("centroid"))


def frame_scores(sampled: DataFrame, cfg: SelectorConfig = SelectorConfig()) -> DataFrame:
    """Frames with representativeness, composite_score (6 places) and rank_in_segment."""
    rows = sampled.join(centroids(sampled), SHOT)
    shot = Window.partitionBy(*SHOT)
    one = F.count(F.lit(1)).over(shot) == 1
    rows = rows.withColumn("representativeness", cosine(F.col("embedding"), F.col("centroid"))).drop("centroid")
    score = cfg.sharpness_weight * zscore(F.col("sharpness"), shot) + cfg.representativeness_weight * zscore(F.col("representativeness"), shot)
    rows = rows.withColumn("composite_score", F.when(one, F.lit(0.0)).otherwise(F.round(score, 6))).withColumn("representativeness", F.when(one, F.lit(1.0)).otherwise(F.col("representativeness")))
    order = shot.orderBy(F.desc("composite_score"), "timestamp_sec", "source_idx")
    return rows.withColumn("rank_in_segment", (F.row_number().over(order) - 1).cast("int"))


def pick_spaced(scored: DataFrame, cfg: SelectorConfig = SelectorConfig()) -> DataFrame:
    """The frames of each shot that are taken in rank order, none too close to one taken before."""
    stream, shot = Window.partitionBy("stream_id").orderBy("segment_id"), Window.partitionBy(*SHOT)
    # Shots are numbered without gaps: the next number's first frame ends a shot, the last ends at its own.
    begin, end = F.min("timestamp_sec").over(shot), F.max("timestamp_sec").over(shot)
    rows = scored.withColumn("_begin", begin).withColumn("_end", F.coalesce(F.min("timestamp_sec").over(stream.rangeBetween(1, 1)), end))
    rows = rows.withColumn("k", target_k(F.greatest(F.col("_end") - F.col("_begin"), F.lit(0.0)), cfg.seconds_per_pick, cfg.max_frames_per_segment)).drop("_begin", "_end")
    space = cfg.min_temporal_spacing_sec

    def step(taken: list, t: float, k: int) -> tuple[bool]:
        ok = not taken or (len(taken) < k and all(abs(t - u) >= space for u in taken))
        if ok:
            taken.append(t)
        return (ok,)

    return fold(rows, SHOT, ["rank_in_segment"], ["timestamp_sec", "k"], list, step, "picked boolean").where("picked").drop("picked", "k")


UNDECIDED, KEPT, GONE = 0, 1, 2


def decide(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """What is certain of a block's candidates, in order: kept if no better one near it is left or undecided, gone if one near it is kept."""
    block = block.sort_values("_id")
    x = np.stack(block["e"].to_numpy())
    gone, blocked = block["gone"].to_numpy(bool), block["blocked"].to_numpy(bool)
    state = np.full(len(x), GONE)
    chosen: list[int] = []  # kept and undecided ones, in order
    near = np.zeros((0, x.shape[1]))
    for k in range(len(x)):
        if gone[k]:
            continue
        like = near[: len(chosen)] @ x[k] > threshold
        those = state[chosen][like] if like.any() else []
        if KEPT in those:
            continue
        state[k] = UNDECIDED if blocked[k] or len(those) else KEPT
        if len(chosen) == len(near):
            near = np.concatenate([near, np.zeros((max(16, len(near)), x.shape[1]))])
        near[len(chosen)] = x[k]
        chosen.append(k)
    return pd.DataFrame({"stream_id": block["stream_id"], "_block": block["_block"], "_id": block["_id"], "e": block["e"], "state": state})


def meet(better: pd.DataFrame, worse: pd.DataFrame, threshold: float, tile: int = 256) -> pd.DataFrame:
    """Candidates of the worse block that are near one of the better block: gone if that one is kept, else blocked."""
    if not len(better) or not len(worse):
        return pd.DataFrame({"_id": [], "gone": [], "blocked": []}).astype({"_id": "int64", "gone": bool, "blocked": bool})
    x, kept, out = np.stack(better["e"].to_numpy()), (better["state"] == KEPT).to_numpy(), []
    for k in range(0, len(worse), tile):
        part = worse.iloc[k : k + tile]
        like = np.stack(part["f"].to_numpy()) @ x.T > threshold
        out.append(pd.DataFrame({"_id": part["of"].to_numpy(), "gone": like[:, kept].any(1), "blocked": like[:, ~kept].any(1)}))
    out = pd.concat(out)
    return out[out["gone"] | out["blocked"]]


def first_free(vectors: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(_id): the candidates that a walk in order of _id keeps, taking none that is too like one taken before; and the rounds that took.

    ``vectors``: stream_id, _block (which holds a stretch of the order), _id, and unit vectors e. In a round a candidate is decided as soon as
    all better ones near it are, so that blocks are judged side by side; pairs of blocks meet in tasks of their own, and no block holds more than
    it and one other.
    """
    kind = "stream_id string, _block int, _id long, e array<double>, state int"
    flags = "_id long, gone boolean, blocked boolean"
    left = checkpoint(vectors.select("stream_id", "_block", "_id", "e"))
    # streams that lie in several blocks, fewer than there are blocks
    wide = left.groupBy("stream_id").agg(F.collect_set("_block").alias("blocks")).where(F.size("blocks") > 1)
    wide = checkpoint(wide)
    many = not wide.isEmpty()
    kept, newly, rounds = None, None, 0
    while True:
        rounds += 1
        if many:
            better = left.withColumn("state", F.lit(UNDECIDED))
            better = better if newly is None else better.unionByName(newly)
            better = better.join(wide, "stream_id").withColumn("j", F.explode(F.filter("blocks", lambda b: b > F.col("_block")))).select("stream_id", F.col("_block").alias("i"), "j", "e", "state")
            worse = left.join(wide, "stream_id").withColumn("i", F.explode(F.filter("blocks", lambda b: b < F.col("_block")))).select(F.col("stream_id").alias("s"), "i", F.col("_block").alias("j"), F.col("_id").alias("of"), F.col("e").alias("f"))
            met = better.groupBy("stream_id", "i", "j").cogroup(worse.groupBy("s", "i", "j")).applyInPandas(lambda a, b: meet(a, b, threshold), flags)
            met = met.groupBy("_id").agg(F.bool_or("gone").alias("gone"), F.bool_or("blocked").alias("blocked"))
            asked = left.join(met, "_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gone", "blocked")})
        else:
            asked = left.withColumns({"gone": F.lit(False), "blocked": F.lit(False)})
        judged = checkpoint(asked.groupBy("stream_id", "_block").applyInPandas(lambda b: decide(b, threshold), kind))
        newly, left = judged.where(F.col("state") == KEPT), judged.where(F.col("state") == UNDECIDED).drop("state")
        kept = newly.select("_id") if kept is None else kept.unionByName(newly.select("_id"))
        if not many or left.isEmpty():
            return kept, rounds


def diversity(candidates: DataFrame, cfg: SelectorConfig = SelectorConfig(), score: str = "composite_score") -> DataFrame:
    """Candidates, best first, that are not too like one kept before; and the best others up to the floor.

    A candidate without an embedding is kept and keeps no other away.
    """
    if cfg.diversity_sim_threshold >= 1:
        return candidates
    order = [F.desc(score), F.col("segment_id"), F.col("timestamp_sec"), F.col("source_idx")]
    rows = in_order(candidates, ["stream_id"], order).withColumn("_block", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    x = F.col("embedding").cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    unit = F.when(size > 0, F.transform(x, lambda v: v / size)).otherwise(x)
    kept, _ = first_free(rows.where("embedding is not null").select(F.to_json(F.struct("stream_id")).alias("stream_id"), "_block", "_id", unit.alias("e")), cfg.diversity_sim_threshold)
    judged = rows.join(kept.withColumn("_kept", F.lit(True)), "_id", "left").withColumn("_kept", F.col("embedding").isNull() | F.coalesce("_kept", F.lit(False)))
    judged = judged.drop("_block")
    have = judged.groupBy("stream_id").agg(F.count_if("_kept").alias("_n"))
    # the best others of each stream: a limit for each group, which Spark takes before it shuffles
    others = judged.where(~F.col("_kept")).withColumn("_d", F.row_number().over(Window.partitionBy("stream_id").orderBy("_id"))).where(F.col("_d") <= max(cfg.min_picks, 0))
    floor = others.join(have.withColumnRenamed("stream_id", "_s"), F.col("stream_id").eqNullSafe(F.col("_s"))).where(F.col("_d") <= cfg.min_picks - F.col("_n"))
    return judged.where("_kept").select(*candidates.columns).unionByName(floor.select(*candidates.columns))


def number_picks(rows: DataFrame, start: int = 1) -> DataFrame:
    order = Window.partitionBy("stream_id").orderBy("timestamp_sec", "source_idx")
    return rows.withColumn("pick_id", (F.row_number().over(order) + (start - 1)).cast("int"))


def select_picks(sampled: DataFrame, cfg: SelectorConfig = SelectorConfig(), diverse: bool = True) -> DataFrame:
    """All picks of segmented frames, which are read twice: ``store.written`` spares folding them again.

    Without ``diverse``: what is known while a stream runs.
    """
    picks = pick_spaced(frame_scores(sampled, cfg), cfg)
    return number_picks(diversity(picks, cfg) if diverse else picks)
