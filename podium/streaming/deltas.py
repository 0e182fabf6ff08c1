"""Streams in update mode: a batch writes what it changed, readers merge, and the pieces are folded from time to time.

A table of this kind is a folder with ``delta/batch=N`` (the changed keys of batch N with their whole new values) and
``base/upto=N`` (all keys as they were after batch N). A key's value is the one of its highest batch. What is written per
batch grows with the keys it touches, not with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import slugify
from ..operators.ranking import direction_of
from ..session import drop_folder

SEEN = "rows_in_time_order"  # name of the observed metrics of a stream made here


def stream_daily_sums(events: DataFrame, keys: Sequence[str], late: str, time: str = "event_time", value: str = "value") -> DataFrame:
    """Streaming (day, keys, value, n): sums and numbers of rows per day. A day's state goes once it is ``late``; later rows of it are dropped.

    Rows without time or value count for nothing. ``late_rows`` tells how many came too late.
    """
    rows = events.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).observe(SEEN, F.count("*").alias("n"))
    sums = rows.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), *keys).agg(F.sum(value).alias("value"), F.count("*").alias("n"))
    return sums.select(F.to_date("day.start").alias("day"), *keys, "value", "n")


def stream_daily_best(events: DataFrame, late: str, direction: str = "desc") -> DataFrame:
    """Streaming (sort_key, entity_id, value, n): the best value of each entity and day while the day is open, for a live leaderboard."""
    extreme = F.min if direction_of(direction) == "asc" else F.max
    rows = events.select("event_time", slugify("entity").alias("entity_id"), "value").dropna().observe(SEEN, F.count("*").alias("n"))
    best = rows.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("day"), "entity_id")
    best = best.agg(extreme("value").alias("value"), F.count("*").alias("n"))
    return best.select(F.date_format("day.start", "yyyyMMdd").cast("bigint").alias("sort_key"), "entity_id", "value", "n")


def write_deltas(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now in update mode. A batch that runs again after a failure overwrites only its own piece."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/delta/batch={number:08d}")

    return (changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers N of the subfolders ``name=N`` that were written to their end, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where)
                  if "=" in f.getPath().getName() and files.exists(done(f.getPath(), "_SUCCESS")))


def _pieces(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(the base to read, if any; the batches after it)"""
    bases = _complete(spark, f"{path}/base")[-1:]
    return bases, [n for n in _complete(spark, f"{path}/delta") if not bases or n > bases[0]]


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Every key once, with the values of the highest batch that has it. One hash aggregation where values are numbers."""
    bases, batches = _pieces(spark, path)
    if not bases and not batches:
        raise FileNotFoundError(f"no complete batch in {path}")
    parts = [spark.read.parquet(f"{path}/base/upto={n:08d}").withColumn("_batch", F.lit(n)) for n in bases]
    if batches:
        deltas = spark.read.option("basePath", f"{path}/delta").parquet(*(f"{path}/delta/batch={n:08d}" for n in batches))
        parts.append(deltas.withColumnRenamed("batch", "_batch"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "_batch").alias(c) for c in values))


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Fold everything into a new base and return its number; None where nothing is new.

    A base counts from its success mark on, so an interrupted run leaves the table as it was. The pieces that the base before
    this one was made from go; those of this one stay until the next time, for readers that have begun.
    """
    bases, batches = _pieces(spark, path)
    if not batches:
        return None
    upto = batches[-1]
    read_latest(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base/upto={upto:08d}")
    if bases:
        for n in _complete(spark, f"{path}/delta"):
            if n <= bases[0]:
                drop_folder(spark, f"{path}/delta/batch={n:08d}")
        for n in _complete(spark, f"{path}/base"):
            if n < bases[0]:
                drop_folder(spark, f"{path}/base/upto={n:08d}")
    return upto


def batch_log(query: StreamingQuery) -> list[dict]:
    """Per batch of a run: rows read in (without those that lack time or value), keys written, keys in state, and its watermark.

    As many batches as ``spark.sql.streaming.numRecentProgressUpdates`` keeps; a longer run needs a larger setting.
    """
    log = []
    for p in query.recentProgress:
        state = p.stateOperators[0] if p.stateOperators else None
        log.append({"batch": p.batchId, "rows": p.observedMetrics[SEEN].n if SEEN in p.observedMetrics else 0, "changed": state.numRowsUpdated if state else 0,
                    "open": state.numRowsTotal if state else 0, "watermark": p.eventTime.get("watermark")})
    return log


def late_rows(spark: SparkSession, path: str, logs: Sequence[dict], count: str = "n") -> DataFrame:
    """One row: rows that the runs with these ``logs`` read, rows that the table's values hold, and the rest, which came too late."""
    read = sum(entry["rows"] for entry in logs)
    bases, batches = _pieces(spark, path)
    keys = [c for c in spark.read.parquet(f"{path}/base/upto={bases[0]:08d}" if bases else f"{path}/delta/batch={batches[0]:08d}").columns if c not in ("value", count)]
    held = read_latest(spark, path, keys).agg(F.coalesce(F.sum(count), F.lit(0)).alias("rows_held"))
    return held.select(F.lit(read).cast("bigint").alias("rows_read"), "rows_held", (F.lit(read) - F.col("rows_held")).alias("rows_late"))
