"""What runs in parallel where the rule is serial: against plain loops, with one stream that holds nearly all rows."""

import bisect
import contextlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.config import SegmenterConfig, SelectorConfig
from scenespark.functions import vectors
from scenespark.operators import joins, prefix, ranks, select, speculate
from scenespark.operators.folds import fold
from scenespark.operators.segment import ShotState


@contextlib.contextmanager
def partitions(spark, n):
    """Sorts go to ``n`` partitions, small ones too."""
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scenes(seed, sizes, cut=0.03, dims=8):
    rng, rows = np.random.default_rng(seed), []
    for stream, n in sizes.items():
        centre = rng.normal(size=dims)
        for k in range(n):
            if rng.random() < cut:
                centre = rng.normal(size=dims)
            rows.append((stream, k, k * 0.5, (centre + 0.3 * rng.normal(size=dims)).tolist()))
    return rows


@pytest.mark.parametrize("cfg,rare", [(SegmenterConfig(sim_threshold=0.5), True), (SegmenterConfig(sim_threshold=0.5, use_ema=False), True), (SegmenterConfig(sim_threshold=0.93, min_shot_sec=40.0), False)])
def test_stitched_shots_equal_the_serial_fold(spark, cfg, rare):
    """One stream has most rows: the shots of its pieces, stitched, are those of one fold, to the last bit."""
    rows = scenes(1, {1: 1500, 2: 5, 3: 100, None: 7, 9: 1})
    df = spark.createDataFrame(rows, "stream_id int, source_idx long, timestamp_sec double, embedding array<double>")
    order, names = ["timestamp_sec", "source_idx"], ["stream_id", "source_idx", "sim_to_shot_mean", "is_shot_start", "segment_id"]
    plain = lambda out: sorted((tuple(r[c] for c in names) for r in out.collect()), key=str)
    want = plain(fold(df, ["stream_id"], order, ["embedding", "timestamp_sec"], lambda: ShotState(cfg), lambda s, e, t: s.ingest(e, t), speculate.ADDS))
    for n in (1, 9):
        with partitions(spark, n):
            out, counts = speculate.stitched(df, "stream_id", order, lambda: ShotState(cfg))
            assert plain(out) == want
        assert counts["pieces"] == n and counts["again"] <= 2 * len(rows) and (n == 1) == (counts["again"] == 0)
        if rare:  # pieces soon meet: a few frames of each are folded twice
            assert counts["rounds"] <= 1 and counts["again"] < 0.4 * len(rows)


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), k, rng.choice([None, 1, 2, 5]), rng.random() if k % 7 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, n int, x double").repartition(5)
    want, so_far = {}, {}
    for k, o, n, x in sorted(rows, key=lambda r: r[1]):
        t = so_far.setdefault(k, [0, 0, 0.0])
        t[0], t[1], t[2] = t[0] + 1, t[1] + (n or 0), t[2] + (x or 0.0)
        want[o] = (t[0], t[1], round(t[2], 9))
    with partitions(spark, 13):
        out = prefix.running(df, ["k"], ["o"], {"rows": None, "ns": "n", "xs": "x"})
        assert {r["o"]: (r["rows"], r["ns"], round(r["xs"], 9)) for r in out.collect()} == want
        held = out.groupBy(F.spark_partition_id()).count().collect()
    # the key with most rows is spread over the tasks
    assert len(held) >= 10 and max(r["count"] for r in held) < 600 / 13 * 2.5
    assert prefix.running(df.where("false"), ["k"], ["o"], {"rows": None}).count() == 0


def test_carried_totals():
    parts = [{"part": 0, "first": (1,), "last": (2,), "keys": 2, "totals": [4]}, {"part": 1, "first": (2,), "last": (2,), "keys": 1, "totals": [10]}, {"part": 3, "first": (2,), "last": (3,), "keys": 2, "totals": [1]}, {"part": 4, "first": (4,), "last": (4,), "keys": 1, "totals": [7]}]
    assert prefix.carries(parts) == {1: [4], 3: [14]}


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    groups = {"many": [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), -rng.random() * 1e300, 0.0, -0.0, 3.0]) for _ in range(700)], "ties": [2.5] * 50 + [1.0] * 3, "one": [7.0], None: [1.0, 2.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("many", None), ("none", None)]
    at = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(at))] for r in ranks.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), "k", "x", at).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert np.allclose(got[k], np.quantile(xs, at), rtol=1e-12, atol=0)


def plain_matches(a, b, tolerance):
    free, n = sorted(b), 0
    for t in sorted(a):
        best = None
        for k, u in enumerate(free):
            if abs(u - t) <= tolerance + 1e-9 and (best is None or abs(u - t) <= abs(free[best] - t)):
                best = k
        if best is not None:
            del free[best]
            n += 1
    return n


def test_match_takes_times_in_order(spark):
    """Ties, repeated times and crowded bands; keys with one side or none."""
    rng, rows, want = random.Random(8), [], {}
    for k in range(60):
        step = rng.choice([0.5, 1.0, 0.1])
        a, b = ([round(rng.randrange(25) * step, 3) for _ in range(rng.choice([0, 3, 20]))] for _ in "ab")
        rows += [(k, "a", t) for t in a] + [(k, "b", t) for t in b]
        n = plain_matches(a, b, 1.5)
        want[k] = (n, len(a), len(b), 1.0 if not a and not b else n / (len(a) + len(b) - n))
    keys = spark.createDataFrame([(k,) for k in want], "k int")
    got = {r["k"]: (r["matched"], r["n_a"], r["n_b"], r["jaccard"]) for r in joins.match_times(spark.createDataFrame(rows, "k int, side string, t double").repartition(3), ["k"], 1.5, keys).collect()}
    assert got == want


def test_free_times_are_few():
    """Times that no later one can reach are not held."""
    free = joins.FreeTimes()
    for k in range(10_000):
        bisect.insort(free.free, float(k))
        free.take(float(k) - 1, 0.4)
    assert len(free.free) < 5


def kept_in_turn(rows, threshold):
    kept = []
    for i, e in rows:
        x = np.array(e)
        x = x / np.sqrt(x @ x) if x.any() else x
        if all(x @ y <= threshold for _, y in kept):
            kept.append((i, x))
    return [i for i, _ in kept]


@pytest.mark.parametrize("n", [1, 8])
def test_diversity_in_rounds_equals_a_walk(spark, n):
    """All rows in one stream and some in another; blocks of it are judged side by side."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6))
    rows = [(k % 11 == 0, k, float(rng.integers(0, 50)), (centres[rng.integers(40)] + 0.25 * rng.normal(size=6)).tolist()) for k in range(500)]
    rows += [(False, 900, 1.0, None), (False, 901, 2.0, [0.0] * 6)]
    schema = "stream_id boolean, source_idx long, composite_score double, embedding array<double>"
    df = spark.createDataFrame(rows, schema).withColumn("segment_id", F.lit(0)).withColumn("timestamp_sec", F.col("source_idx") * 1.0).repartition(3)
    with partitions(spark, n):
        for least in (0, 60):
            got = select.diversity(df, SelectorConfig(diversity_sim_threshold=0.8, min_picks=least)).collect()
            for stream in (False, True):
                walk = sorted((r for r in rows if r[0] == stream), key=lambda r: (-r[2], r[1]))
                kept = kept_in_turn([(r[1], r[3]) for r in walk if r[3]], 0.8) + [r[1] for r in walk if not r[3]]
                more = [r[1] for r in walk if r[1] not in kept][: max(0, least - len(kept))]
                assert sorted(r["source_idx"] for r in got if r["stream_id"] == stream) == sorted(kept + more)
        blocks = df.where("embedding is not null").select(F.lit("s").alias("stream_id"), (F.col("source_idx") / 100).cast("int").alias("_block"), F.col("source_idx").alias("_id"), F.col("embedding").alias("e"))
        unit = blocks.withColumn("e", F.transform("e", lambda v: v / 10))
        some, rounds = select.first_free(unit, 0.01)
        walk = sorted(((r["_id"], np.array(r["e"])) for r in unit.collect()), key=lambda r: r[0])
        kept = []
        for i, x in walk:
            if all(x @ y <= 0.01 for _, y in kept):
                kept.append((i, x))
        assert sorted(r["_id"] for r in some.collect()) == [i for i, _ in kept] and 2 <= rounds <= 9


@pytest.mark.parametrize("cell", [0.5, 7.0, 1e6])
def test_nearest_frame_against_all_pairs(spark, cell):
    """Cells of any width: ties in time and index, times before 0, nulls, points far from all frames, streams without frames."""
    rng = random.Random(4)
    streams = [1, 1, 1, 1, 2, None]
    frames = [(rng.choice(streams), k, rng.choice([rng.randint(-60, 60) / 4, None] if k % 9 == 0 else [rng.randint(-60, 60) / 4])) for k in range(300)]
    frames += [(1, 999, f[2]) for f in frames[:20]]
    points = [(rng.choice([*streams, 3]), k, rng.choice([-500.0, 500.0, None]) if k % 10 == 0 else rng.randint(-200, 200) / 8) for k in range(200)]
    f = spark.createDataFrame(frames, "stream_id int, source_idx long, timestamp_sec double")
    p = spark.createDataFrame(points, "stream_id int, point long, t double")
    want = {}
    for stream, k, t in points:
        near = [] if t is None else [(abs(x - t), x, i) for s, i, x in frames if s == stream and x is not None]
        want[k] = (stream, t, *(min(near)[1:] if near else (None, None)))
    got = joins.nearest(f, p, cell_sec=cell).collect()
    assert len(got) == len(points) and {r["point"]: (r["stream_id"], r["t"], r["frame_t"], r["source_idx"]) for r in got} == want
    assert joins.nearest(f.where("false"), p).where("source_idx is not null").count() == 0 and joins.nearest(f, p.where("false")).count() == 0


def test_variance_makes_its_vector_once_a_row(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0],), ([0.5] * 64,), (None,)], "e array<double>")
    got = rows.select(vectors.var_pop(F.transform("e", lambda v: v * 2))).collect()
    assert [r[0] for r in got] == [38.0, 0.0, None]
    plan = rows.select(vectors.var_pop(F.transform("e", lambda v: v * 1234.5)).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1234.5") == 1
