"""Shots and picks: golden cases, edges, and equal results of the different ways to run."""

import math

import pytest
from pyspark.sql import functions as F

from scenespark.config import SegmenterConfig, SelectorConfig
from scenespark.operators.segment import ShotState, event_log, segment_frames, segment_frames_sql, segment_rollup
from scenespark.operators.select import diversity, number_picks, pick_spaced, select_picks

SCHEMA = "stream_id int, source_idx long, analyzed_idx int, timestamp_sec double, embedding array<float>, sharpness double"


def frames(spark, rows, stream=0):
    """rows: (time, vector) or (time, vector, sharpness)."""
    return spark.createDataFrame([(stream, int(k), k, float(r[0]), r[1], float(r[2]) if len(r) > 2 else 100.0) for k, r in enumerate(rows)], SCHEMA)


def flags(spark, rows, **cfg):
    out = segment_frames(frames(spark, rows), SegmenterConfig(**cfg)).orderBy("source_idx").collect()
    return [r["is_shot_start"] for r in out]


X, Y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]


def test_golden_shots(spark):
    assert flags(spark, [(0, X)], sim_threshold=0.9, min_shot_sec=0.0) == [True]
    assert flags(spark, [(0, X), (1, [0.99, 0.01, 0.0])], sim_threshold=0.9, min_shot_sec=0.0) == [True, False]
    assert flags(spark, [(0, X), (1, X), (2, Y)], sim_threshold=0.9, min_shot_sec=0.0) == [True, False, True]
    assert flags(spark, [(0, X), (0.5, Y)], sim_threshold=0.9, min_shot_sec=3.0) == [True, False]
    assert flags(spark, [(0, X)] + [(i, [1.0, 0.02 * i, 0.0]) for i in range(1, 6)], sim_threshold=0.9, min_shot_sec=0.0) == [True] + [False] * 5


def test_zero_vectors_cut_and_nan_never_does(spark):
    assert flags(spark, [(0, X), (1, [0.0, 0.0, 0.0]), (2, X)], sim_threshold=0.9, min_shot_sec=0.0) == [True, True, True]
    assert flags(spark, [(0, X), (1, [math.nan, 0.0, 0.0]), (2, Y)], sim_threshold=0.9, min_shot_sec=0.0) == [True, False, False]


def test_rows_out_of_order_and_null_embeddings(spark):
    rows = frames(spark, [(2, Y), (0, X), (1, X), (3, None)])
    out = {r["timestamp_sec"]: r["is_shot_start"] for r in segment_frames(rows, SegmenterConfig(sim_threshold=0.9, min_shot_sec=0.0)).collect()}
    assert out == {0.0: True, 1.0: False, 2.0: True}
    assert segment_frames(rows.limit(0)).count() == 0


def test_finalise_goes_on_numbering():
    s = ShotState(SegmenterConfig(sim_threshold=0.9, min_shot_sec=0.0))
    assert s.finalise() is None
    assert s.ingest(X, 0.0) == (1.0, True, 0) and s.finalise() == 0
    assert s.ingest(Y, 5.0) == (1.0, True, 1)


def test_shots_tile_time(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    from scenespark.sources.frames import frames_from_embeddings

    f = frames_from_embeddings(vectors)
    cfg = SegmenterConfig(sim_threshold=0.05)
    s = segment_frames(f, cfg)
    shots = segment_rollup(s).orderBy("stream_id", "segment_id").collect()
    top = {}
    for a, b in zip(shots, shots[1:]):
        if a["stream_id"] == b["stream_id"]:
            assert a["end_sec"] == b["start_sec"] and b["segment_id"] == a["segment_id"] + 1
        top[b["stream_id"]] = b["segment_id"]
    assert [top[k] for k in range(5)] == [21, 19, 18, 23, 15]
    assert event_log(s).count() == len(shots) - 10
    key = ["stream_id", "source_idx", "is_shot_start", "segment_id"]
    one = s.select(*key, F.round("sim_to_shot_mean", 6).alias("sim")).collect()
    two = segment_frames_sql(f, cfg).select(*key, F.round("sim_to_shot_mean", 6).alias("sim")).collect()
    assert sorted(one) == sorted(two)


def sampled(spark, rows, segments=None):
    f = frames(spark, rows)
    if segments is None:
        return f.withColumn("segment_id", F.lit(0))
    return f.join(spark.createDataFrame(list(enumerate(segments)), "source_idx long, segment_id int"), "source_idx")


def test_single_frame(spark):
    out = select_picks(sampled(spark, [(0, X)])).collect()
    assert [(r["pick_id"], r["representativeness"], r["composite_score"], r["rank_in_segment"]) for r in out] == [(1, 1.0, 0.0, 0)]


def test_spacing(spark):
    cfg = SelectorConfig(max_frames_per_segment=3, seconds_per_pick=0.5, min_temporal_spacing_sec=1.0, sharpness_weight=1.0, representativeness_weight=0.0, diversity_sim_threshold=1.0)
    t = sorted(r["timestamp_sec"] for r in select_picks(sampled(spark, [(0.2 * i, X, 100 - i) for i in range(10)]), cfg).collect())
    assert len(t) > 1 and all(b - a >= 1.0 - 1e-9 for a, b in zip(t, t[1:]))


def test_all_ties(spark):
    cfg = SelectorConfig(max_frames_per_segment=4, seconds_per_pick=5.0, min_temporal_spacing_sec=0.5, diversity_sim_threshold=1.0)
    out = select_picks(sampled(spark, [(i, X, 50) for i in range(20)]), cfg).orderBy("pick_id").collect()
    assert [r["timestamp_sec"] for r in out] == [0.0, 1.0, 2.0, 3.0]


def test_near_duplicates_and_floor(spark):
    three = sampled(spark, [(0, X), (1, X), (2, Y)], [0, 1, 2])
    assert select_picks(three, SelectorConfig(diversity_sim_threshold=0.99, min_picks=1)).count() == 2
    four = sampled(spark, [(i, X) for i in range(4)], range(4))
    assert select_picks(four, SelectorConfig(diversity_sim_threshold=0.5, min_picks=3)).count() == 3
    assert select_picks(four, SelectorConfig(diversity_sim_threshold=1.0, min_picks=3)).count() == 4
    assert select_picks(four, SelectorConfig(diversity_sim_threshold=0.5, min_picks=9)).count() == 4


def test_null_embeddings_are_kept_and_block_nothing(spark):
    rows = sampled(spark, [(0, None), (1, X), (2, X)], range(3)).withColumn("composite_score", F.lit(0.0))
    out = diversity(rows, SelectorConfig(diversity_sim_threshold=0.9, min_picks=0))
    assert sorted(r["source_idx"] for r in out.collect()) == [0, 1]
    assert [r["pick_id"] for r in number_picks(out, 5).orderBy("timestamp_sec").collect()] == [5, 6]


@pytest.mark.parametrize("per,most,want", [(0.0, 4, 4), (8.0, 4, 1), (2.0, 2, 2)])
def test_target_number(spark, per, most, want):
    cfg = SelectorConfig(max_frames_per_segment=most, seconds_per_pick=per, min_temporal_spacing_sec=0.0)
    rows = sampled(spark, [(i, X) for i in range(6)]).withColumn("rank_in_segment", F.col("analyzed_idx")).withColumn("composite_score", F.lit(0.0))
    assert pick_spaced(rows, cfg).count() == want


def test_kept_picks_are_unlike_each_other(spark):
    from scenespark.plans.queries import SEL, keyed

    _, k = keyed(spark, "/root/testdata/sf0.01", SelectorConfig(**{**SEL.__dict__, "min_picks": 0}))
    from scenespark.functions.vectors import np_cosine

    import numpy as np

    by = {}
    for r in k.collect():
        by.setdefault(r["stream_id"], []).append(np.array(r["embedding"], float))
    assert all(np_cosine(a, b) <= 0.2 + 1e-12 for v in by.values() for i, a in enumerate(v) for b in v[:i])
