"""A corpus pipeline: classify, drop near copies, redact secrets, mix sources, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import bpe, mixing, quality, secrets, simhash
from scenespark.llm.common import checkpoint, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any; repeated rows go or stay together, texts of any length are
    measured whole; other columns pass through.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, any id before none.

    Texts link at a similarity of 0.8 or more of their shingles of five words; candidates come from the index of
    fingerprints, or, among texts of its long lists, from their shingles, and each is compared whole before it links. Rows without an id link and go like others; of rows with equal ids in a group one stays, and
    rows with equal ids in different groups all stay. Null and empty texts are one group. Of equal ids
    in a group the row that stays is the first as the input was stored. Texts of any length are compared whole. Columns may have any names.
    """
    rows = stored(docs.select(F.struct(*docs.columns).alias("own"), F.monotonically_increasing_id().alias("row")))
    groups = simhash.near_copies(rows.select("row", F.col("own.text").alias("text")))
    first = F.min(F.struct(F.col("own.doc_id").isNull(), F.col("own.doc_id"), F.col("row").alias("row")))
    stay = rows.select("row", F.struct(F.col("own.doc_id").alias("doc_id")).alias("own")).join(groups, "row").groupBy("component").agg(first.alias("x")).select("x.row")
    return rows.join(stay, "row", "left_semi").select("own.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, null, empty and repeated ones too; what the scan finds is replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document; none for those it leaves.

    Texts without words, null ones among them, are no part of a mix by words and go. Columns may have any names.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, with their digest and that of the text decoded from them.

    The last stage: it returns doc_id, n_tokens, ids_sha256, decoded_sha256 and ids, a row for each row it gets.
    """
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality classifier", classify), ("near duplicates", dedup), ("secret scan", redact), ("mixing", mix), ("byte-pair encoding", encode)]

#: The classifier, the fingerprints and the merges have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to a checkpoint that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
