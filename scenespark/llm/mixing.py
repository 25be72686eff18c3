"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources are clamped at a maximum number of epochs and the excess weight is dealt to the
others in proportion, until none is above its cap. In closed form: in the order of cap
over weight, the first sources that reach their caps do so at a common water level.
Whole repetitions of each document follow from its source's target; the fraction that is
left takes once more the documents whose seeded hash lies below a cut, found from sums
of sizes per source and hash bucket (65,536 of them, by the first four hexadecimal digits of an MD5):
first the 256 sums of 256 buckets each, then the buckets of the one where the cut lies, so that no task
sees more than 256 rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycled(weights: tuple[float, ...]) -> Column:
    """Weights by the sources' order, repeating; null comes last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)


def targets(totals: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """totals: (source, source_size, weight), a row per source. Adds target.

    The windows go over the sources' totals, a row each, never over documents.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.col("fills").asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    t = totals.withColumn("cap", cap).withColumn("fills", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    t = t.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    t = t.withColumn("open", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # A source is full if the level reached before it is its own turn or beyond.
    level = F.when(F.col("rest") > 0, F.col("open") / F.col("rest"))
    t = t.withColumn("level", level).withColumn("full", F.coalesce(F.col("fills") <= F.col("level"), F.lit(False)))
    t = t.withColumn("water", F.min(F.when(~F.col("full"), F.struct("fills", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"])
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.least("cap", F.col("weight") * F.coalesce("water", F.lit(0.0)))))).select("source", "source_size", "weight", "target")


def cut_places(sums: DataFrame, goal: DataFrame) -> DataFrame:
    """(s, cut): for each source the number of buckets, from 0 up, whose words come nearest to what is left, less one.

    sums: (source, bucket, words); goal: (source, more). A source for which taking nothing is nearest has no row.
    """
    chunk = F.shiftright("bucket", 8)
    goal = goal.select(F.col("source").alias("s"), "more")
    same = F.col("source").eqNullSafe(F.col("s"))
    order = Window.partitionBy("source").orderBy("chunk")
    upper = sums.groupBy("source", chunk.alias("chunk")).agg(F.sum("words").alias("words"))
    upper = upper.withColumn("before", F.sum("words").over(order) - F.col("words")).join(goal, same).drop("s")
    # the last chunk before whose words there is something left to take
    at = upper.where("before < more").groupBy(F.col("source").alias("s")).agg(F.max_by(F.struct("chunk", "before", "more"), "chunk").alias("x"))
    inner = sums.join(at, same & (chunk == F.col("x.chunk"))).select("source", "bucket", (F.col("x.before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).alias("upto"), F.col("x.more").alias("more"))
    begin = at.select(F.col("s").alias("source"), (F.col("x.chunk") * 256 - 1).alias("bucket"), F.col("x.before").alias("upto"), F.col("x.more").alias("more"))
    near = inner.unionByName(begin).where("abs(upto - more) < more")
    return near.groupBy(F.col("source").alias("s")).agg(F.max_by("bucket", F.struct(-F.abs(F.col("upto") - F.col("more")), -F.col("bucket"))).alias("cut"))


def repetitions(rows: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """rows: (source, size, bucket, others). Adds source_size, target and repeats."""
    sums = checkpoint(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(totals.withColumn("weight", cycled(weights)), max_epochs, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.least(F.floor(ratio + 1e-12), F.lit(int(max_epochs))).cast("long")).withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    cut = F.when(F.col("whole") >= int(max_epochs), -1).otherwise(F.coalesce("cut", F.lit(-1))).alias("cut")
    goal = goal.join(cut_places(sums, goal), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", cut)
    goal = small(checkpoint(goal))  # a row per source: with it broadcast, documents stay where they are
    repeats = F.when(F.col("size") > 0, F.col("whole") + (F.col("bucket") <= F.col("cut")).cast("long")).otherwise(F.lit(0))
    return rows.join(goal, F.col("s").eqNullSafe(F.col("source"))).withColumn("repeats", repeats.cast("long"))


def sized(docs: DataFrame, seed: int, id_col: str, *more: Column) -> DataFrame:
    of = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 4), 16, 10).cast("int")
    return docs.select(of.alias("source"), word_count(F.col("text")).alias("size"), bucket.alias("bucket"), *more)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, share: float = 1.0, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, source, size, source_size, target, repeats, taken.

    Size is the number of words, of texts of any length (null text: 0). A null source is a source of its own, the
    last. Rows that share an id are taken alike, so that runs agree; null counts as an id. A source without words has the
    target 0 and takes nothing. Of cuts that are equally near the one with fewer words is taken. An empty table gives no rows; other columns are not read.
    """
    rows = checkpoint(sized(docs, seed, id_col, F.col(id_col).cast("long").alias("_id")))  # the texts are read once
    out = repetitions(rows, weights, max_epochs, share)
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, share: float = 1.0, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The documents themselves, with their own columns whatever their names, a row for each repetition that ``mix`` takes."""
    rows = sized(docs, seed, id_col, F.struct(*docs.columns).alias("_row"))
    out = repetitions(rows, weights, max_epochs, share).where("repeats > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")
