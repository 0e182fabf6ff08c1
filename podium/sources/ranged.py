"""Large written artefacts (tapes) in ranges of a whole-numbered key, with a fingerprint per range and a manifest written last.

A reader takes a stretch of the key by partition pruning. A recomputed table is compared range by range: fingerprints are sums of
row hashes, which need no order, and only ranges whose fingerprints differ are read and compared row by row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from ..session import write_stage

RANGE = "_range"
#: The range of rows without a key.
NO_KEY = -(1 << 62)
_SUMS = ("rows", "high_1", "low_1", "high_2", "low_2")


def _range_of(key: str, width: int) -> Column:
    k = F.col(f"`{key}`").cast("bigint")
    return F.coalesce(F.call_function("div", k - F.pmod(k, F.lit(width)), F.lit(width)), F.lit(NO_KEY))


def fingerprints(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows and four sums per ``_range``: the halves of two 64-bit hashes of each row, nulls told from absence. Sums hold for 2^31 rows a range."""
    parts = [part for c in columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = rows.select(RANGE, *[F.xxhash64(F.lit(seed), *parts).alias(f"_h{seed}") for seed in (1, 2)])
    halves = [F.sum(half).alias(f"{name}_{seed}") for seed in (1, 2)
              for name, half in (("high", F.shiftright(f"_h{seed}", 32)), ("low", F.col(f"_h{seed}").bitwiseAND(F.lit((1 << 32) - 1))))]
    return hashes.groupBy(RANGE).agg(F.count("*").alias("rows"), *halves)


def write_ranged(df: DataFrame, path: str, key: str, width: int, order: Sequence[str] = ()) -> None:
    """Write ``df`` to ``path`` in ranges of ``width`` values of ``key``, sorted by ``key`` and ``order``. A range that is large is several files."""
    spark, columns = df.sparkSession, df.columns
    ranged = df.withColumn(RANGE, _range_of(key, width))
    laid = ranged.repartitionByRange(RANGE, key, *order).sortWithinPartitions(RANGE, key, *order)
    laid.write.mode("error").partitionBy(RANGE).parquet(f"{path}/rows")
    # A table without rows leaves no folder of a range; its schema is the manifest's.
    fingerprints(spark.read.schema(ranged.schema).parquet(f"{path}/rows"), columns).write.parquet(f"{path}/ranges")
    spark.createDataFrame([(key, width, df.schema.json())], "key string, width bigint, schema string").write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> tuple[Row, StructType]:
    found = spark.read.parquet(f"{path}/manifest").first()
    return found, StructType.fromJson(json.loads(found["schema"]))


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(RANGE, LongType())).parquet(f"{path}/rows")


def read_ranged(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows whose key lies from ``first`` to ``last``; files of other ranges are not opened. An artefact without manifest was not finished: an error."""
    manifest, schema = _manifest(spark, path)
    rows, key, width = _rows(spark, path, schema), F.col(f"`{manifest['key']}`"), manifest["width"]
    if first is not None:
        rows = rows.filter((F.col(RANGE) >= first // width) & (key >= first))
    if last is not None:
        rows = rows.filter((F.col(RANGE) <= last // width) & (key <= last))
    return rows.drop(RANGE)


def changed_ranges(spark: SparkSession, path: str, again: DataFrame) -> DataFrame:
    """(_range, rows_written, rows_again) of the ranges in which the written artefact and ``again`` differ. ``ranges`` of the artefact is all that is read of it."""
    manifest, schema = _manifest(spark, path)
    new = fingerprints(again.select(*[F.col(f"`{c}`") for c in schema.names], _range_of(manifest["key"], manifest["width"]).alias(RANGE)), schema.names)
    old = spark.read.parquet(f"{path}/ranges").withColumnsRenamed({s: f"old_{s}" for s in _SUMS})
    alike = F.lit(True)
    for s in _SUMS:
        alike = alike & F.col(s).eqNullSafe(F.col(f"old_{s}"))
    both = old.join(new, RANGE, "full").filter(~alike)
    return both.select(RANGE, F.coalesce("old_rows", F.lit(0)).alias("rows_written"), F.coalesce("rows", F.lit(0)).alias("rows_again"))


def ranged_difference(spark: SparkSession, path: str, again: DataFrame) -> DataFrame:
    """Rows found on one side only, repeats counted, with ``side`` written or again; empty when the artefact still holds.

    ``again`` has the artefact's columns, in any order. It is staged, since its fingerprints and its rows are both read.
    """
    manifest, schema = _manifest(spark, path)
    again = write_stage(again.select(*[F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(schema.names, schema.fields)]), "again")
    # The filter tells the planner that few ranges remain, so that it prunes the artefact's partitions while it runs.
    unequal = write_stage(changed_ranges(spark, path, again), "unequal").filter((F.col("rows_written") > 0) | (F.col("rows_again") > 0)).select(RANGE)
    old = _rows(spark, path, schema).join(unequal, RANGE, "left_semi").drop(RANGE)
    new = again.withColumn(RANGE, _range_of(manifest["key"], manifest["width"])).join(unequal, RANGE, "left_semi").drop(RANGE)
    return old.exceptAll(new).withColumn("side", F.lit("written")).unionByName(new.exceptAll(old).withColumn("side", F.lit("again")))
