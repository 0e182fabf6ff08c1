"""What the operators share: tables of a folder, tidy inputs, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: The most tasks that a short list of files or blocks is dealt to.
TASKS = 100_000
#: Separators between words and, alone, between equal texts.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, nor with an underscore behind it, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while taken & {name, name + "_"}:
        name = f"_{name}"
    return name


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null text is empty, other columns are left behind."""
    return docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """k1, k2: 128 bits that stand for a document's id and text. Null ids have keys, too; equal rows have equal keys."""
    doc_id, text = col(id_col).cast("bigint"), F.coalesce(col(text_col), F.lit(""))
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")]


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, of which Spark no longer knows that it lies by its long ``keys``.

    A hot key's rows are split among tasks (AQE skew join) only where both sides of a join come straight from a shuffle.
    The result of a grouping by the join's keys does not; with its keys rewritten it is shuffled once more, as few rows.
    """
    return df.withColumns({k: F.bitwise_not(F.bitwise_not(col(k))) for k in keys})


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, byte_bound: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``byte_bound`` bytes (one long row may exceed it)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows, batch.num_rows - at)
            part = batch.slice(at, take)
            while take > 1 and part.get_total_buffer_size() and part.nbytes > byte_bound:
                take = max(1, take // 2)
                part = batch.slice(at, take)
            yield part
            at += take
