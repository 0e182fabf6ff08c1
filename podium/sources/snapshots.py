"""Dated ranking lists to a yearly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..functions import clean
from ..operators.ordering import first_per_group


def snapshot_series(lists: DataFrame, first_year: int, last_year: int, mmdd: str = "0101", top_n: int = 10,
                    list_size: int = 100, offsets: tuple[int, ...] = fixed.SNAPSHOT_OFFSETS, least_list: int | None = None, least_rows: int = 10) -> DataFrame:
    """``lists(day date, rank, entity)`` to (entity, year, score) with one list per year.

    A year takes the first of its wanted day and the days around it whose list has ``least_list`` rows (10, or ``top_n`` if that
    is fewer, by default). Scores fall with rank. Fewer than ``least_rows`` rows in all are no series: the result is empty. Days without a list never join, so the
    lists are read once for the days asked for.
    """
    spark: SparkSession = lists.sparkSession
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    base = F.to_date(F.format_string(f"%04d{mmdd}", "year"), "yyyyMMdd")
    wanted = years.select("year", base.alias("base"), F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("place", "offset"))
    wanted = wanted.select("year", "place", F.date_add("base", F.col("offset")).alias("day"))
    usable = lists.filter((F.col("rank") >= 1) & (F.col("rank") == F.floor("rank")))
    sizes = usable.groupBy("day").agg(F.count("*").alias("rows")).filter(F.col("rows") >= (min(10, top_n) if least_list is None else least_list))
    chosen = wanted.join(sizes, "day").groupBy("year").agg(F.min_by("day", "place").alias("day"))
    rows = first_per_group(usable.join(chosen, "day"), ["year"], [F.col("rank"), F.col("entity")], top_n, "_n")
    total = rows.agg(F.count("*")).scalar()
    return rows.filter(total >= least_rows).select("entity", "year", (F.lit(list_size + 1) - F.col("rank")).alias("score"))


def is_domain(column: Column) -> Column:
    """Whether a cell looks like a host name."""
    return F.lower(clean(column)).rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")


def domain_ranks(rows: DataFrame, rank: str, domain: str, *keep: str) -> DataFrame:
    """(rank, entity and ``keep``) of the rows of a list that are a whole rank from 1 on and a host name; headers and notes go."""
    number = clean(F.col(rank).cast("string"))
    whole = F.when(number.rlike(r"^\d{1,18}$"), number.cast("bigint"))
    usable = rows.filter((whole >= 1) & is_domain(F.col(domain)))
    return usable.select(whole.alias("rank"), F.lower(clean(F.col(domain))).alias("entity"), *keep)
