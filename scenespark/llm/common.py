"""What the operators of this subpackage share: tables, checkpoints, batches of rows, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_folder, written

#: Code points that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """The table with a hint to broadcast it if its rows, as JSON, hold at most ``most`` bytes; else as it is, for a join by shuffle.

    The size is counted over the whole table, which should be a checkpoint.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def by_row(df: DataFrame, columns: list[str | Column], schema: str, rows: Callable[[list[tuple]], dict[str, list]], chunk: int = 512) -> DataFrame:
    """Run ``rows`` over the selected columns, ``chunk`` rows at a time, in Arrow batches.

    ``rows`` takes a list of columns (each a list of values) and returns the output's columns.
    Memory is bounded by one Arrow batch and what ``rows`` makes of one chunk.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = rows([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def text_bytes(name: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b"")).alias(name)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the value as text, modulo m (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps over an edge table; each round is a
    handful of shuffles of the edges, checkpointed, and the rounds grow with the
    logarithm of the longest chain. Nothing but two numbers a round reaches the driver.
    The hub of a star is never gathered: each step is a min per node, which is
    pre-aggregated, and a join on the node, which adaptive execution can split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    seen = None
    while True:
        # large star: each neighbour above the node goes to the node's smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below a node, and the node, go to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpoint(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # at the fixed point each edge leads from a node to the root of its star
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def labels_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n points by links u-v."""
    lab = np.arange(n)
    while True:
        old = lab.copy()
        low = np.minimum(lab[u], lab[v])
        np.minimum.at(lab, u, low)
        np.minimum.at(lab, v, low)
        lab = lab[lab]
        if (lab == old).all():
            return lab


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder: smaller than a checkpoint's rows.

    The write's own shuffle files go as soon as it ends; else they would stay until the driver's
    memory fills.
    """
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, None)
    conf.set(clean, "true")
    try:
        return written(df)
    finally:
        conf.unset(clean) if before is None else conf.set(clean, before)


def released(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for a table that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
