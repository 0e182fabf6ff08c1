"""A written ranking that is kept up to date: after a revision only the periods it touches are ranked and written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import drop_folder, write_stage
from .ordering import ranked_stage
from .ranking import best_first, direction_of

#: Columns of a written ranking. ``version``: the revision that wrote the row's period.
SCHEMA = "entity_id string, value double, rank bigint, rank_delta bigint, version bigint, sort_key bigint"
_NAMES = ["entity_id", "value", "rank", "rank_delta", "version", "sort_key"]


def _change(rank: str = "rank") -> Column:
    """Places won since the entity's last appearance. A window partition is an entity: one row per period."""
    return F.lag(rank).over(Window.partitionBy("entity_id").orderBy("sort_key")) - F.col(rank)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Partitioned by period; a period is a few files in order of rank, a large one is spread over tasks."""
    laid = rows.select(*_NAMES).repartitionByRange("sort_key", "rank").sortWithinPartitions("sort_key", "rank")
    laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("sort_key").parquet(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def write_ranking(cells: DataFrame, path: str, direction: str = "desc") -> DataFrame:
    """Rank ``cells`` (sort_key, entity_id, value; one row per cell) in full and write them. Cells without a value take no part."""
    plain = write_stage(cells.select(F.col("sort_key").cast("bigint").alias("sort_key"), "entity_id", F.col("value").cast("double").alias("value")).dropna(), "first-cells")
    ranked = ranked_stage(plain, ["sort_key"], best_first(direction_of(direction)), name="first-ranks")
    _write(ranked.withColumn("rank_delta", _change()).withColumn("version", F.lit(1).cast("bigint")), path, "error")
    return read_ranking(cells.sparkSession, path)


def revise_ranking(spark: SparkSession, path: str, edits: DataFrame, direction: str = "desc") -> DataFrame:
    """Apply ``edits`` (ord, sort_key, entity_id, value; null removes the cell, of several for a cell the last ``ord`` counts).

    Only periods with a cell that really changes are ranked again. An entity whose rank or presence changed there may have
    another change of rank in its next appearance: those rows are patched. The periods of both kinds, and no others, are written
    (dynamic partition overwrite), with the next version; a period that loses its last cell goes.
    The new periods are staged before any file is replaced, so a failed run can be repeated.
    """
    old = read_ranking(spark, path)
    cell = ["sort_key", "entity_id"]
    wanted = edits.groupBy(F.col("sort_key").cast("bigint").alias("sort_key"), "entity_id").agg(F.max_by(F.col("value").cast("double"), "ord").alias("new"))
    wanted = wanted.dropna(subset=cell)
    real = wanted.join(old.select(*cell, "value"), cell, "left").filter(~F.col("new").eqNullSafe(F.col("value"))).select(*cell, "new", F.lit(True).alias("edited"))
    real = write_stage(real, "edits")
    # The comparison lets Spark prune the partitions of the other side by these periods.
    touched = real.select("sort_key").distinct().filter(F.col("sort_key") > F.lit(-1 << 62))
    inside = write_stage(old.join(touched, "sort_key", "left_semi"), "old-periods")
    cells = inside.select(*cell, "value").join(real, cell, "full")
    cells = cells.select(*cell, F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value")).dropna(subset=["value"])
    ranked = write_stage(ranked_stage(write_stage(cells, "new-cells"), ["sort_key"], best_first(direction_of(direction)), name="new-ranks"), "ranked-again")

    before = inside.select(*cell, F.col("rank").alias("old_rank"), F.col("rank_delta").alias("old_delta"))
    moved = ranked.select(*cell, "rank").join(before, cell, "full").filter(~F.col("rank").eqNullSafe(F.col("old_rank")))
    moved = write_stage(moved.select("entity_id").distinct(), "moved")
    outside = old.join(touched, "sort_key", "left_anti").select(*cell, "rank", "rank_delta", F.lit(False).alias("again"))
    line = outside.unionByName(ranked.select(*cell, "rank", F.lit(None).cast("bigint").alias("rank_delta"), F.lit(True).alias("again")))
    line = line.join(moved, "entity_id", "left_semi").withColumn("delta", _change())
    line = write_stage(line.filter(F.col("again") | ~F.col("delta").eqNullSafe(F.col("rank_delta"))).select(*cell, "delta", "again"), "changes")

    version = old.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).scalar()
    again = ranked.join(line.filter("again").withColumnRenamed("again", "_new"), cell, "left").join(before.drop("old_rank"), cell, "left")
    again = again.withColumn("rank_delta", F.when(F.col("_new"), F.col("delta")).otherwise(F.col("old_delta")))
    patches = line.filter("NOT again").select(*cell, "delta", F.lit(True).alias("_new"))
    patched = old.join(patches.select("sort_key").distinct().filter(F.col("sort_key") > F.lit(-1 << 62)), "sort_key", "left_semi").join(patches, cell, "left")
    patched = patched.withColumn("rank_delta", F.when(F.col("_new"), F.col("delta")).otherwise(F.col("rank_delta")))
    names = ["entity_id", "value", "rank", "rank_delta", "sort_key"]
    result = write_stage(again.select(*names).unionByName(patched.select(*names)).withColumn("version", version), "new-periods")
    _write(result, path, "overwrite")
    for row in touched.join(ranked, "sort_key", "left_anti").toLocalIterator():  # periods without a cell: nothing overwrites them
        drop_folder(spark, f"{path}/sort_key={row.sort_key}")
    spark.catalog.refreshByPath(path)
    return read_ranking(spark, path)
