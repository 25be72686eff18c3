"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorted by fractional
rank, rows of every source come evenly, and equal cuts of that order match the mixture.
Both orders are range-partitioned sorts of narrow rows, numbered by partition offsets, so
that a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add each row's place, from 0, in a total order, without one task that sees all rows.

    The sorted rows are checkpointed, so that every later read finds the same places; the
    offsets are a row for each partition.
    """
    bits = F.lit((1 << 33) - 1)
    # the place within a partition, and the partition, are the two parts of this id
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(bits))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the number of partitions
    offset, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offset[r["_part"]], at = at, at + r["n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(sorted(offset.items()), "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_at", "_part", "_in", "_before")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), source.

    The shards' row counts differ by one at most, and so do the counts of a source in
    them, but for where cuts fall between rows of equal fractional rank. A null text has size 1 and
    the crc of nothing; a null source is a source of its own; a null id and repeated rows are rows like any
    other, and equal rows are interchangeable, so that runs agree. An empty table gives no rows.
    """
    data = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    of = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), of.alias("source"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), id_col, "text_crc32"))
    ranked = numbered(rows, [F.col("source"), F.col("_h"), F.col(id_col), F.col("text_crc32"), F.col("size")], "_place")
    per = ranked.groupBy(F.col("source").alias("_s")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    part = (2 * (F.col("_place") - F.col("_first")) + 1) / (2 * F.col("_n"))
    # Ties of fractional rank are dealt by a hash, lest the same sources always come first.
    mixed = ranked.join(per, F.col("source").eqNullSafe(F.col("_s"))).select(id_col, "source", "size", "text_crc32", "_h", part.alias("_f"))
    tie = F.xxhash64(F.lit(seed + 1), "source", "_f")
    placed = numbered(mixed, [F.col("_f"), tie, F.col("source"), F.col("_h"), F.col(id_col), F.col("text_crc32"), F.col("size")], "_place")
    n = placed.count()
    first = F.expr(f"(cast(shard as decimal(20,0)) * {n} + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", F.expr(f"cast((cast(_place as decimal(20,0)) * {shards}) div {max(n, 1)} as int)")).withColumn("slot", F.col("_place") - first)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
