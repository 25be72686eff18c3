"""Click-to-sale attribution as a stateful stream, restarted for each batch of arrivals.

Clicks and sales are dealt into batches by the hour they arrived. A batch is a folder that is moved
into the stream's input when its turn comes; one streaming query, on one checkpoint, is started anew
for each. Its state is two packed arrays for each group of clients, clicks and open sales, both sorted by NumPy; two
binary searches count a sale's clicks and find the last. A group times out at its earliest open sale.

The watermark that closes sales must follow both inputs' largest times over all earlier batches, in
microseconds, whether or not the query was restarted since. Spark's is in milliseconds and forgets each
input's own time at a restart, so every row carries the mark that its batch brings; Spark's watermark on that mark wakes the
groups, and the exact one judges times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import fresh_path
from .common import crc_mod, stored

HOUR, DAY = 3_600_000_000, 86_400_000_000
LAG, REACH = 6 * HOUR, 7 * DAY
#: Stands for no id, which comes after all ids.
NONE = np.iinfo(np.int64).max
CLICK, SALE, END = 0, 1, 2
OUT = "row long, sale_id long, batch int, late boolean, click_id long, click_at long, n_clicks long"
NAMES = [x.split()[0] for x in OUT.split(", ")]
STATE = "clicks binary, sales binary"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp: one without a zone counts as UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")


def batch_of(hour: Column, lo: int, hi: int, batches: int) -> Column:
    """floor(batches * (h - lo) / (hi - lo + 1)), clamped to the batches; a row that never arrived comes with the last."""
    at = F.floor((hour - lo) * batches / F.lit(hi - lo + 1)).cast("int")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(batches - 1), at)), F.lit(batches - 1))


def matches(clicks: np.ndarray, client: np.ndarray, sold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sale its number of clicks, and time and id of the last (0 and NONE if there is none).

    ``clicks`` has rows client, time, id, sorted by client, time and falling id, so that the last of
    equal times is that of the smallest id. Client and time are ranked, which makes them one number to search.
    """
    times = np.unique(np.concatenate([clicks[1], sold, sold - REACH]))
    who = np.unique(np.concatenate([clicks[0], client]))
    code = lambda c, t: np.searchsorted(who, c) * len(times) + np.searchsorted(times, t)
    held = code(clicks[0], clicks[1])
    lo = np.searchsorted(held, code(client, sold - REACH), side="left")
    hi = np.searchsorted(held, code(client, sold), side="right")
    n, at = hi - lo, np.maximum(hi - 1, 0)
    if not clicks.shape[1]:
        return n, np.zeros_like(sold), np.full(len(sold), NONE)
    return n, np.where(n > 0, clicks[1][at], 0), np.where(n > 0, clicks[2][at], NONE)


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(rows, -1)


def emitted(sales: np.ndarray, batch: int, late: bool, n: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    whole = lambda x, gone: pd.array(np.where(gone, 0, x), dtype="Int64")
    out = pd.DataFrame({"row": sales[2], "sale_id": whole(sales[3], sales[3] == NONE), "batch": np.int32(batch), "late": late, "click_id": whole(ids, ids == NONE), "click_at": whole(at, n == 0), "n_clicks": n})
    out.loc[sales[3] == NONE, "sale_id"] = pd.NA
    out.loc[ids == NONE, "click_id"] = pd.NA
    out.loc[n == 0, "click_at"] = pd.NA
    return out[NAMES]


def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, batch: int, mark: int | None, ends: bool, base: int) -> Iterator[pd.DataFrame]:
    """One group's part of a batch: late sales out, the rest buffered, sales before the mark closed, old clicks gone."""
    clicks, sales = (unpacked(x, k) for x, k in zip(state.get, (3, 4), strict=True)) if state.exists else (np.zeros((3, 0), np.int64), np.zeros((4, 0), np.int64))
    if not state.hasTimedOut:
        new = pd.concat(list(parts))
        rows = new[["client", "t", "id", "row", "kind"]].to_numpy(np.int64).T
        c, s = rows[:3, rows[4] == CLICK], rows[[0, 1, 3, 2]][:, rows[4] == SALE]
        if mark is not None:
            c, late = c[:, c[1] >= mark], s[1] < mark
            if late.any():
                gone = s[:, late]
                zero = np.zeros(gone.shape[1], np.int64)
                yield emitted(gone, batch, True, zero, zero, zero + NONE)
            s = s[:, ~late]
        if c.shape[1]:
            clicks = np.concatenate([clicks, c], axis=1)
            clicks = clicks[:, np.lexsort((-clicks[2], clicks[1], clicks[0]))]
        sales = np.concatenate([sales, s], axis=1)
    closing = np.ones(sales.shape[1], bool) if ends else sales[1] < mark if mark is not None else np.zeros(sales.shape[1], bool)
    if closing.any():
        done = sales[:, closing]
        n, at, ids = matches(clicks, done[0], done[1])
        yield emitted(done, batch, False, n, at, ids)
        sales = sales[:, ~closing]
    if mark is not None:
        clicks = clicks[:, clicks[1] >= mark - REACH]
    if ends or not clicks.shape[1] and not sales.shape[1]:
        if state.exists:
            state.remove()
        return
    state.update((np.ascontiguousarray(clicks).tobytes(), np.ascontiguousarray(sales).tobytes()))
    # the earliest open sale, or the moment at which the last click is of no more use
    next_at = sales[1].min() if sales.shape[1] else clicks[1].max() + REACH
    state.setTimeoutTimestamp(max(int(next_at - base) // 1000 - 1, state.getCurrentWatermarkMs(), 1))


def dealt(clicks: DataFrame, sales: DataFrame, batches: int, key_rows: int, slot: int) -> tuple[DataFrame, list[int | None], int]:
    """Rows of both inputs with batch and key; the mark before each batch; the earliest time.

    Clients share keys by a hash, but those with over a sixty-fourth of the rows, 64 at most, have a key for every ``slot`` of time: a
    click lies in its slot's, and a sale asks all the slots that its days of reach touch.
    """
    spark = clicks.sparkSession
    hour = lambda df, of: F.floor(micros(df, "arrived_at") / F.lit(HOUR)).cast("long") + F.when(crc_mod(of, 4) == 0, 240).otherwise(0)
    c = clicks.select(F.col("click_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("t"), hour(clicks, "click_id").alias("h"))
    # one row of an id: of rows that differ, a complete one
    c = c.where("client is not null and t is not null").groupBy("id").agg(F.min(F.struct("t", "client", "h")).alias("x")).select("id", "x.*")
    c = stored(c)
    s = sales.select(F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("t"), hour(sales, "sale_id").alias("h"))
    s = stored(s.where("client is not null and t is not null").withColumn("row", F.monotonically_increasing_id()))
    lo, hi = c.agg(F.min("h"), F.max("h")).first()
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    both = c.withColumn("row", F.lit(None).cast("long")).withColumn("kind", F.lit(CLICK)).unionByName(s.withColumn("kind", F.lit(SALE)))
    both = both.withColumn("batch", batch_of(F.col("h"), lo, hi, batches))
    seen = {(r["batch"], r["kind"]): r for r in both.groupBy("batch", "kind").agg(F.max("t").alias("t"), F.min("t").alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # two rows a batch
    marks: list[int | None] = []
    top: dict[int, int] = {}
    for k in range(batches + 1):
        marks.append(min(top.values()) - LAG if len(top) == 2 else None)
        for kind in (CLICK, SALE):
            if (k, kind) in seen:
                top[kind] = max(top.get(kind, seen[k, kind]["t"]), seen[k, kind]["t"])
    n = sum(r["n"] for r in seen.values())
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // key_rows))
    hot = sorted(r["client"] for r in both.groupBy("client").count().where(F.col("count") > n / 64).collect())
    own = F.lit(groups).cast("long") + F.array_position(F.array(*[F.lit(x).cast("long") for x in hot]), F.col("client")) - 1 if hot else None
    at = lambda t: F.floor(t / F.lit(slot)).cast("long")
    slots = F.when(F.col("kind") == SALE, F.sequence(at(F.col("t") - REACH), at(F.col("t")))).otherwise(F.array(at(F.col("t"))))
    # a hot client's keys lie above the groups: its place in the list, and the slot, which may be below zero
    keys = F.array(F.pmod(F.xxhash64("client"), F.lit(groups)))
    if hot:
        keys = F.when(F.col("client").isin(hot), F.transform(slots, lambda x: own + (x + F.lit(1 << 40)) * F.lit(64))).otherwise(keys)
    rows = both.withColumn("key", F.explode(keys)).select("batch", "kind", "key", "client", "t", F.coalesce("id", F.lit(int(NONE))).alias("id"), F.coalesce("row", F.lit(-1).cast("long")).alias("row"))
    base = min((r["first"] for r in seen.values()), default=0) - REACH - LAG - DAY
    return rows, marks, base


def folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def attribute(clicks: DataFrame, sales: DataFrame, batches: int = 12, key_rows: int = 100_000, slot: int = REACH // 2) -> DataFrame:
    """One row per sale: sale_id, batch, late, click_id, n_clicks, click_at (microseconds since 1970).

    Rows without a client or a time are dropped; of clicks with one id one row counts (the earliest, then that of the smallest client,
    then that which arrived first); clicks without an id are one. Sales are never merged: repeated rows stay
    repeated, and a sale without an id keeps its row. A row without arrived_at comes with the last batch. Of clicks at one
    time the smaller id wins. Without clicks all sales close at the stream's end with none; without sales there are no rows. Other columns
    are not read. The folder of the run is made anew at every call, and its inputs and state are removed at its end.
    """
    spark = clicks.sparkSession
    path = fresh_path(spark)
    rows, marks, base = dealt(clicks, sales, batches, key_rows, slot)
    rows.write.partitionBy("batch").parquet(f"{path}/dealt")
    shape = T.StructType([f for f in rows.schema if f.name != "batch"] + [T.StructField("mark", T.LongType())])
    plain = spark.read.schema(rows.schema).parquet(f"{path}/dealt")
    silent, conf = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf
    before = conf.get(silent)
    # a batch of its own after each would wake groups before the next batch's rows are there
    conf.set(silent, "false")
    try:
        for k in range(batches + 1):
            brought = marks[min(k + 1, batches)]
            arrived = plain.where(F.col("batch") == k).drop("batch") if k < batches else ends(plain)
            arrived.withColumn("mark", F.lit(None if brought is None else brought - base).cast("long")).write.parquet(f"{path}/ready/{k}")
            fs, ready = folder(spark, f"{path}/ready/{k}")
            fs.mkdirs(folder(spark, f"{path}/in")[1])
            if not fs.rename(ready, folder(spark, f"{path}/in/{k}")[1]):
                raise OSError(f"cannot move {path}/ready/{k}")
            run(spark, path, shape, partial(step, batch=k, mark=marks[k], ends=k == batches, base=base))
    finally:
        conf.set(silent, before)
    for name in ("dealt", "ready", "in", "state"):
        fs, gone = folder(spark, f"{path}/{name}")
        fs.delete(gone, True)
    out = spark.read.schema(OUT).parquet(f"{path}/out")
    # a hot client's sale has a part from each slot
    last = F.min(F.when(F.col("n_clicks") > 0, F.struct((-F.col("click_at")).alias("back"), F.coalesce("click_id", F.lit(int(NONE))).alias("order"), "click_id", "click_at")))
    whole = out.groupBy("row").agg(F.first("sale_id").alias("sale_id"), F.first("batch").alias("batch"), F.first("late").alias("late"), F.sum("n_clicks").alias("n_clicks"), last.alias("x"))
    return whole.select("sale_id", "batch", "late", F.col("x.click_id").alias("click_id"), "n_clicks", F.col("x.click_at").alias("click_at"))


def ends(rows: DataFrame) -> DataFrame:
    """A row for each key: the stream's end, which wakes all groups."""
    zero = F.lit(0).cast("long")
    return rows.select("key").distinct().select(F.lit(END).alias("kind"), "key", zero.alias("client"), zero.alias("t"), zero.alias("id"), zero.alias("row"))


def run(spark: SparkSession, path: str, shape: T.StructType, each) -> None:
    """Start the query on its checkpoint, let it take what has come in, and stop."""
    rows = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    # no mark yet: the epoch, at which Spark's watermark begins
    rows = rows.withColumn("mark", F.timestamp_micros(F.coalesce("mark", F.lit(0)) + LAG)).withWatermark("mark", "6 hours")
    out = rows.groupBy("key").applyInPandasWithState(each, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
