"""Structured Streaming: incremental sums of growing files, and a leaderboard kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import parse_date, slugify
from ..operators.ordering import first_per_group
from ..operators.ranking import best_first, direction_of
from ..operators.shape import name_year_rows


def stream_name_year_sums(spark: SparkSession, folder: str, schema: str, entity: str, date: str, value: str,
                          file_format: str = "csv", files_per_trigger: int = 100, **options: str) -> DataFrame:
    """Streaming (entity, date) sums over the files of a folder. State holds one row per pair, not the input.

    Cells are dealt out to all cores before they are parsed, which takes longer than reading: a batch may be one file that cannot
    be split.
    """
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if file_format == "csv":
        options = {"header": "true", "quote": '"', "escape": '"', **options}
    rows = reader.options(**options).load(folder).select(*dict.fromkeys((entity, date, value)))
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism)
    return name_year_rows(rows, entity, date, value).groupBy("entity", "date").agg(F.sum("value").alias("value"))


def stream_cells(obs: DataFrame, direction: str = "desc") -> DataFrame:
    """Streaming best value per (sort_key, entity_id). State holds one row per cell; every period stays open."""
    extreme = F.min if direction_of(direction) == "asc" else F.max
    keyed = obs.select(parse_date("date")["sort_key"].alias("sort_key"), slugify("entity").alias("entity_id"), "value")
    return keyed.dropna().groupBy("sort_key", "entity_id").agg(extreme("value").alias("value"))


def stream_daily_cells(events: DataFrame, late: str, direction: str = "desc") -> DataFrame:
    """As ``stream_cells`` for events with an ``event_time``: a day closes, and its state goes, once it is ``late``."""
    extreme = F.min if direction_of(direction) == "asc" else F.max
    day = F.window("event_time", "1 day")
    keyed = events.withWatermark("event_time", late).select("event_time", slugify("entity").alias("entity_id"), "value")
    cells = keyed.dropna().groupBy(day.alias("day"), "entity_id").agg(extreme("value").alias("value"))
    return cells.select(F.date_format("day.start", "yyyyMMdd").cast("bigint").alias("sort_key"), "entity_id", "value")


def write_current_tables(sums: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run over the files that are there now; each batch writes the whole current result as its own table.

    A batch overwrites only its own folder, so a batch that runs again after a failure leaves the same files.
    """
    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return (sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_leaderboard(cells: DataFrame, top_n: int, direction: str = "desc") -> DataFrame:
    """Top-N of each period from cells: the per-batch step of a live leaderboard."""
    return first_per_group(cells, ["sort_key"], best_first(direction_of(direction)), top_n)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The result written by the latest batch."""
    tables = spark.read.parquet(path)
    return tables.filter(F.col("batch") == tables.agg(F.max("batch")).scalar()).drop("batch")


def append_stream(rows: DataFrame, path: str, checkpoint: str, file_format: str = "json") -> StreamingQuery:
    """Append-only log of a stream."""
    return (rows.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
