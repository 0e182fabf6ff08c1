"""Order-based numbering that never puts one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_stage



def ranked_stage(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank",
                 name: str = "ranked") -> DataFrame:
    """Write ``df`` in the given order and number the rows 1, 2, ... inside each group of ``keys``.

    ``row_number().over(partitionBy(keys))`` would sort a whole group in one task. Here the rows are range
    partitioned on keys and order together, so a group holding a third of the data spans a third of the tasks.
    Each task's rows are consecutive, hence a rank is "rows of my group in earlier tasks" plus "my place in this
    task". The first part is a table of one row per (task, group). ``order`` must be a total order in a group.
    The result is read back from files, which pins the task placement the numbering depends on.
    """
    columns = [F.col(k) for k in keys]
    laid = (df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order)
            .withColumn("_place", F.monotonically_increasing_id()))
    laid = write_stage(laid.withColumn("_task", F.spark_partition_id().cast("bigint")), name)
    same_task = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    blocks = laid.groupBy("_task", *keys).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(same_task), F.lit(0))).drop("_rows")
    # Written so that the planner knows its true size and decides itself whether it may be broadcast.
    blocks = write_stage(blocks.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_task": "_t"}), name + "-blocks")
    match = laid["_task"] == blocks["_t"]
    for k in keys:
        match = match & laid[k].eqNullSafe(blocks[f"_k_{k}"])
    joined = laid.join(blocks, match, "inner")
    numbered = joined.withColumn(rank, F.col("_before") + F.col("_place") - F.col("_first") + 1)
    return numbered.select(*df.columns, rank)


def first_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows, in order. Each task keeps k rows and one task merges them, so k must fit in a task."""
    return df.orderBy(*order).limit(k)


def first_rows_spread(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows in a total order with their ``rank``, for any k. The result stays spread over tasks and is not sorted."""
    ranked = ranked_stage(df.withColumn("_all", F.lit(0)), ["_all"], order, rank=rank, name="first-rows")
    return ranked.filter(F.col(rank) <= k).drop("_all")


def rows_beyond(df: DataFrame, value: str, k: int, descending: bool = True, size: int = 2048) -> DataFrame:
    """Written rows of ``df`` among which the ``k`` largest (or smallest) of a numeric column surely are, few more than k if it can be had.

    A quantile sketch of ``size`` proposes a bound, the number of rows beyond it proves it. With fewer than k there, a wider
    bound is tried, and at last all rows are taken (as for k beyond the number of values). The bound holds on doubles, whose order
    never contradicts that of longer integers and decimals. NaN is larger than any number, null comes last in both directions.
    """
    number = F.col(f"`{value}`").cast("double")
    sketch = df.agg(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(size)).alias("s"))
    sketch = write_stage(sketch, "sketch")  # one row, read for each bound that is tried
    total = sketch.select(F.kll_sketch_get_n_double("s")).first()[0] or 0
    for margin in (0.005, 0.05):
        share = k / total + margin if total else 1.0
        if share >= 1.0:
            break
        bound = sketch.select(F.kll_sketch_get_quantile_double("s", F.lit(1.0 - share if descending else share))).first()[0]
        found = write_stage(df.filter(number >= bound if descending else number <= bound), "beyond")
        if found.count() >= k:
            return found
    return write_stage(df, "beyond")


def first_rows_sketched(df: DataFrame, value: str, ties: Sequence[Column], k: int, descending: bool = True, rank: str = "rank") -> DataFrame:
    """As ``first_rows_spread`` for an order that begins with a number: only rows beyond a bound from a sketch are sorted.

    ``ties`` must make the order total. Costs one pass for the sketch and one for the rows beyond the bound.
    """
    leading = F.col(f"`{value}`")
    order = [leading.desc_nulls_last() if descending else leading.asc_nulls_last(), *ties]
    return first_rows_spread(rows_beyond(df, value, k, descending), order, k, rank)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """The ``n`` first rows of each group, with their place.

    Spark applies the ``rank <= n`` limit in every task before the shuffle, so at most n rows per group and task
    travel, whatever the size of the group. Above ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) it
    does not; ``first_per_group_spread`` is for such n.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    return df.withColumn(rank, place).filter(F.col(rank) <= n)


def first_per_group_spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """As ``first_per_group`` for any n: rows are ranked across tasks. ``order`` must be a total order in a group."""
    return ranked_stage(df, keys, order, rank, name="top").filter(F.col(rank) <= n)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str,
                  include_current: bool = False, name: str = "previous") -> DataFrame:
    """Add the latest non-null ``value`` among the earlier rows (or this one, too) of the row's group.

    ``lag`` and ``last`` over ``partitionBy(keys)`` sort a whole group in one task. This lays the rows out as
    ``ranked_stage`` does: windows run inside one task's share of a group, and only the last value of each task
    is handed on to the next one.
    """
    columns = [F.col(k) for k in keys]
    laid = (df.withColumn("_value", value).repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order)
            .withColumn("_place", F.monotonically_increasing_id()))
    laid = write_stage(laid.withColumn("_task", F.spark_partition_id().cast("bigint")), name)
    share = Window.partitionBy("_task", *keys).orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    # Rows are in order of key across tasks, so a series that begins before a task can only be the task's first one, and
    # what a task hands on is the last value of its last series: one row per task, whatever the number of series.
    key = F.struct(*keys)
    known = F.when(F.col("_value").isNotNull(), F.col("_place"))
    edges = laid.groupBy("_task").agg(F.min_by(key, "_place").alias("_first"), F.max_by(key, "_place").alias("_last"),
                                      F.max_by(F.struct(key.alias("k"), F.col("_value").alias("v")), known).alias("_said"))
    given = F.when(F.col("_said.k").eqNullSafe(F.col("_last")), F.col("_said"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # over one row per task
    edges = edges.withColumn("_said", F.last(given, ignorenulls=True).over(earlier)).select("_task", "_first", "_said")
    rows = laid.withColumn(out, F.last("_value", ignorenulls=True).over(share)).join(F.broadcast(edges), "_task", "left")
    mine = key.eqNullSafe(F.col("_first")) & key.eqNullSafe(F.col("_said.k"))
    return rows.withColumn(out, F.coalesce(F.col(out), F.when(mine, F.col("_said.v")))).select(*df.columns, out)


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, before: str, after: str,
                    name: str = "neighbours") -> DataFrame:
    """Add the latest non-null ``value`` of the earlier rows and the first one of the later rows of the row's group.

    Both directions use one written lay-out, made as in ``with_previous``: one range exchange, and values handed on from task to
    task both ways. ``order`` must be a total order in a group, but for rows without a value.
    """
    columns, key = [F.col(k) for k in keys], F.struct(*keys)
    laid = (df.withColumn("_value", value).repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order)
            .withColumn("_place", F.monotonically_increasing_id()))
    laid = write_stage(laid.withColumn("_task", F.spark_partition_id().cast("bigint")), name)
    # A task hands forward the last value of its last series and backward the first value of its first one.
    known, pair = F.when(F.col("_value").isNotNull(), F.col("_place")), F.struct(key.alias("k"), F.col("_value").alias("v"))
    edges = laid.groupBy("_task").agg(F.min_by(key, "_place").alias("_first"), F.max_by(key, "_place").alias("_last"),
                                      F.max_by(pair, known).alias("_closing"), F.min_by(pair, known).alias("_opening"))
    forward = F.when(F.col("_closing.k").eqNullSafe(F.col("_last")), F.col("_closing"))
    backward = F.when(F.col("_opening.k").eqNullSafe(F.col("_first")), F.col("_opening"))
    past = (Window.unboundedPreceding, -1)  # windows over one row per task
    edges = edges.select("_task", "_first", "_last", F.last(forward, ignorenulls=True).over(Window.orderBy("_task").rowsBetween(*past)).alias("_from"),
                         F.last(backward, ignorenulls=True).over(Window.orderBy(F.col("_task").desc()).rowsBetween(*past)).alias("_to"))
    share = Window.partitionBy("_task", *keys)
    rows = laid.withColumns({
        before: F.last("_value", ignorenulls=True).over(share.orderBy("_place").rowsBetween(*past)),
        after: F.last("_value", ignorenulls=True).over(share.orderBy(F.col("_place").desc()).rowsBetween(*past))}).join(F.broadcast(edges), "_task", "left")
    given = lambda edge, said: F.when(key.eqNullSafe(F.col(edge)) & key.eqNullSafe(F.col(said + ".k")), F.col(said + ".v"))
    return rows.withColumns({before: F.coalesce(before, given("_first", "_from")),
                             after: F.coalesce(after, given("_last", "_to"))}).select(*df.columns, before, after)
