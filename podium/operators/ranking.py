"""Per-period leaderboards: cells, ranks, rank changes, movers, counters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import display_label, frequency_of_hint, parse_date, slugify
from ..session import write_stage
from .ordering import first_per_group, ranked_stage


def direction_of(name: str | None) -> str:
    return "asc" if (name or "").lower() in ("asc", "ascending", "bottom") else "desc"


def best_first(direction: str, value: str = "value", tie: str = "entity_id") -> list[Column]:
    """Ranked end first, rows without a value last, ties by entity id."""
    v = F.col(value)
    return [v.asc_nulls_last() if direction == "asc" else v.desc_nulls_last(), F.col(tie).asc_nulls_last()]


def with_period(obs: DataFrame) -> DataFrame:
    """Add entity_id, iso, frequency and sort_key; a frequency hint beats the frequency of the spelling."""
    obs = obs.withColumn("_date", parse_date("date"))
    hint = frequency_of_hint("frequency") if "frequency" in obs.columns else F.lit(None).cast("string")
    return obs.withColumns({
        "entity_id": slugify("entity"), "iso": F.col("_date.iso"), "sort_key": F.col("_date.sort_key"),
        "frequency": F.coalesce(hint, F.col("_date.frequency")),
    }).drop("_date")


def entity_cells(obs: DataFrame, direction: str = "desc") -> DataFrame:
    """One row per (sort_key, entity_id).

    Two steps. The first groups by the raw spellings with numeric buffers only, so it runs as a hash aggregation
    with map-side combine and dates and names are parsed once per spelling, not once per row. The second merges
    spellings. Rows that cannot be ranked are kept as counts (``n_valued = 0``, or no sort_key): the drop counters
    and first-seen names then need no second pass over the observations.
    """
    for optional in ("status", "frequency"):
        if optional not in obs.columns:
            obs = obs.withColumn(optional, F.lit(None).cast("string"))
    extreme = F.min if direction == "asc" else F.max
    spelled = obs.groupBy("entity", "date", "frequency", "status").agg(
        extreme("value").alias("value"), F.count("value").alias("n_valued"), F.count("*").alias("n_rows"),
        F.min(F.when(F.col("value").isNotNull(), F.col("ord"))).alias("valued_ord"), F.min("ord").alias("ord"))
    dated = F.col("sort_key").isNotNull()
    return with_period(spelled).groupBy("sort_key", "entity_id").agg(
        extreme(F.when(dated, F.col("value"))).alias("value"),
        F.sum(F.when(dated, F.col("n_valued")).otherwise(0)).alias("n_valued"),
        F.sum("n_rows").alias("n_rows"),
        F.min_by(F.coalesce("status", F.lit("SUPPORTED")), "valued_ord").alias("status"),
        F.min_by(F.struct("iso", "frequency"), "valued_ord").alias("period"),
        F.min("valued_ord").alias("period_ord"),
        F.min_by("entity", "ord").alias("name"),
        F.min("ord").alias("name_ord"),
    ).withColumn("status", F.when(F.col("n_valued") > 1, F.lit("DUPLICATE")).otherwise(F.col("status")))


def period_table(cells: DataFrame) -> DataFrame:
    """Periods in time order: index, iso, label, sort_key, frequency. One row per distinct period."""
    found = cells.filter("n_valued > 0").groupBy("sort_key").agg(F.min_by("period", "period_ord").alias("period"))
    index = F.row_number().over(Window.orderBy("sort_key")).cast("bigint") - 1
    return found.select(index.alias("period_index"), F.col("period.iso").alias("iso"),
                        display_label("period.iso", "period.frequency").alias("label"), "sort_key",
                        F.col("period.frequency").alias("frequency"))


@dataclass
class Ranking:
    """A leaderboard over staged ``plain`` cells. What needs no full ranks (a tape, periods, counters) never sorts them all."""

    plain: DataFrame
    top_n: int | None
    mover_threshold: int
    direction: str

    @cached_property
    def cells(self) -> DataFrame:
        """Every cell with its full rank in its period. Laid out on first use."""
        return ranked_stage(self.plain, ["sort_key"], best_first(self.direction), name="cells")

    @cached_property
    def top(self) -> DataFrame:
        """The valued cells of the top-N with their rank: at most N per period and task travel to find them."""
        valued = self.plain.filter("n_valued > 0")
        return write_stage(first_per_group(valued, ["sort_key"], best_first(self.direction), self.top_n), "top-cells")

    def periods(self) -> DataFrame:
        return period_table(self.plain)

    def starred(self) -> DataFrame:
        """Ids of the entities that reach the top-N in some period."""
        return self.top.select("entity_id").distinct()

    def names(self) -> DataFrame:
        """(entity_id, entity): first-seen spelling of the starred entities."""
        return self.plain.join(self.starred(), "entity_id", "left_semi").groupBy("entity_id").agg(F.min_by("name", "name_ord").alias("entity"))

    def rows(self) -> DataFrame:
        """Ranked rows (top-N), with the change against the last period the entity appeared in.

        The change uses full ranks, so the windows below see every cell of the entities that ever reach the
        top-N, and only those. A window partition is one entity: at most one row per period.
        """
        cells = self.cells if self.top_n is None else self.cells.join(self.starred(), "entity_id", "left_semi")
        entity = Window.partitionBy("entity_id")
        named = cells.withColumn("entity", F.min_by("name", "name_ord").over(entity)).filter("n_valued > 0")
        before = F.lag("rank").over(entity.orderBy("sort_key"))
        changed = named.withColumn("rank_delta", before - F.col("rank"))
        if self.top_n is not None:
            changed = changed.filter(F.col("rank") <= self.top_n)
        mover = F.coalesce(F.abs("rank_delta") >= self.mover_threshold, F.lit(False))
        return (changed.drop("period").join(self.periods(), "sort_key")
                .select("entity", "entity_id", F.col("iso").alias("period_iso"), F.col("label").alias("period_label"),
                        "period_index", "sort_key", "value", "rank", "rank_delta", mover.alias("is_mover"), "status"))

    def entity_order(self) -> DataFrame:
        """Entities by the sum of their ranked values, ranked end first."""
        ranked = self.plain.filter("n_valued > 0") if self.top_n is None else self.top
        return ranked.groupBy("entity_id").agg(F.sum("value").alias("total")).orderBy(*best_first(self.direction, "total"))

    def counters(self) -> DataFrame:
        return drop_counters(self.plain)


def drop_counters(cells: DataFrame) -> DataFrame:
    """Dropped rows (an unreadable date is counted before a missing value) and duplicated cells."""
    undated = F.col("sort_key").isNull()
    missing = F.col("n_rows") - F.col("n_valued")
    return cells.agg(
        F.coalesce(F.sum(F.when(undated, F.col("n_rows"))), F.lit(0)).alias("dropped_unparsable_date"),
        F.coalesce(F.sum(F.when(~undated, missing)), F.lit(0)).alias("dropped_missing_value"),
        F.count(F.when(F.col("n_valued") > 1, F.lit(1))).alias("duplicate_cells"))


def rank_observations(obs: DataFrame, top_n: int | None = None, mover_threshold: int = 2,
                      direction: str = "desc") -> Ranking:
    """Rank ``obs`` (ord, entity, date, value; optional status and frequency) inside each period."""
    direction = direction_of(direction)
    # Written first: the range lay-out of full ranks samples its input, and must not run the aggregation for that.
    return Ranking(write_stage(entity_cells(obs, direction), "plain-cells"), top_n, mover_threshold, direction)


def top_per_period(obs: DataFrame, top_n: int, direction: str = "desc") -> DataFrame:
    """Only the top-N of each period, without rank changes: one shuffle and a limited second one."""
    direction = direction_of(direction)
    cells = entity_cells(obs, direction).filter("n_valued > 0").select("sort_key", "entity_id", "value", "status")
    return first_per_group(cells, ["sort_key"], best_first(direction), top_n)
