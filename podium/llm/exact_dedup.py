"""Exact de-duplication by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages
from .common import BLANKS, documents

_DIGEST = ["digest", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(text, BLANKS, " ")


def _merge(runs: DataFrame, bits: int) -> DataFrame:
    """One round: 2^bits neighbouring runs meet, each digest once per merged run.

    A run holds a digest once, so a group is at most 2^bits rows, however many copies the corpus has.
    """
    met = runs.withColumn("run", F.shiftright("run", bits)).repartition("run", "digest")
    return met.sortWithinPartitions("run", *_DIGEST).groupBy("run", *_DIGEST).agg(
        F.min("first").alias("first"), F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Each input partition becomes a run of digests, sorted, each with its smallest document and its number of copies.
    Runs meet in binomial rounds: in each, 2^fan_in_bits neighbours exchange by digest, are merged in order, and the
    smallest document survives, until one run is left. It is spread over all tasks by digest, as every run is. Two
    texts are equal when SHA-256, length in bytes and a second 64-bit hash agree, at every level.

    Null text is empty. Null ids come after all others. Of repeated rows (same id, same text) exactly one is kept.
    Texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession, "exact-dedup")
    # A struct of (id is null, id, row) orders null ids last and breaks ties among repeated rows.
    texts = documents(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    rows = stages.write(texts.select(
        F.spark_partition_id().alias("run"), F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id",
                                                      F.monotonically_increasing_id().alias("row")).alias("me"),
        F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.xxhash64("text").alias("second")), "digests")
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.groupBy("run", *_DIGEST).agg(F.min("me").alias("first"), F.count("*").alias("copies"))
    while last > 0:
        runs, last = _merge(runs, fan_in_bits), last >> fan_in_bits
    repeated = runs.filter("copies > 1").select(*_DIGEST, "first", "copies")
    joined = rows.join(repeated, _DIGEST, "left")
    stays = F.coalesce("first", "me")
    return joined.select(
        F.col("me.doc_id").alias("doc_id"), stays["doc_id"].alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"),
        (stays["row"] == F.col("me.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
