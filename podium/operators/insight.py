"""What happened in a tape or dataset: events, picked facts, spotlights, group totals, scores, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as fixed
from ..functions import format_spec_value, leading_year, year_label
from .ordering import first_per_group
from .tape import Tape


def boundary_bars(tape: Tape, include_last: bool = False) -> DataFrame:
    """(period_index, entity_id, rank, value) drawn at the first frame of each transition.

    The last period has no such frame; ``include_last`` adds it from the filled series.
    """
    bars = tape.bars(hold=False, moments="boundaries").select(
        F.col("transition").alias("period_index"), "entity_id", "rank", "value")
    if not include_last:
        return bars
    end = tape.boundary_ranks().filter(F.col("period_index") == tape.n_periods - 1)
    return bars.filter(F.col("period_index") < tape.n_periods - 1).unionByName(end.select(bars.columns))


def tape_events(boundaries: DataFrame, climb: int = 3) -> DataFrame:
    """Newcomers (first time drawn), jumps (``climb`` or more places since the period before), lead changes.

    ``boundaries`` holds at most top-N rows per period, so a window over one entity, or over the one leader per
    period, stays as small as the number of periods.
    """
    history = Window.partitionBy("entity_id").orderBy("period_index")
    past = boundaries.withColumns({"before": F.lag("period_index").over(history), "from_rank": F.lag("rank").over(history)})
    adjacent = F.col("before") == F.col("period_index") - 1
    jumped = F.coalesce(adjacent & (F.col("from_rank") - F.col("rank") >= climb), F.lit(False))
    kind = F.when(F.col("before").isNull(), F.lit("newcomer")).when(jumped, F.lit("jump"))
    moves = past.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "period_index", "kind", "entity_id", "rank", "value", F.when(F.col("kind") == "jump", F.col("from_rank")).alias("from_rank"))
    leaders = boundaries.filter("rank = 1")
    led = F.lag("entity_id").over(Window.orderBy("period_index"))  # one row per period
    changes = leaders.withColumn("led", led).filter(F.col("led") != F.col("entity_id")).select(
        "period_index", F.lit("overtake").alias("kind"), "entity_id", "rank", "value", F.lit(None).cast("bigint").alias("from_rank"))
    return moves.unionByName(changes)


def pick_facts(events: DataFrame, n_periods: int, count: int) -> DataFrame:
    """The most interesting event of each of ``count`` equal stretches of the timeline."""
    interest = (F.when(F.col("kind") == "overtake", 110 - F.col("rank"))
                .when(F.col("kind") == "newcomer", 60 - F.col("rank"))
                .otherwise(30 + F.col("from_rank") - F.col("rank")))
    bucket = F.ceil((F.col("period_index") + 1) * count / F.lit(float(n_periods))) - 1
    order = [F.col("interest").desc(), F.col("period_index"), (F.col("kind") == "overtake").asc(), F.col("rank")]
    scored = events.withColumns({"interest": interest.cast("bigint"), "bucket": bucket.cast("bigint")})
    return first_per_group(scored, ["bucket"], order, 1, "_n").drop("_n")


def fact_sentences(facts: DataFrame, names: DataFrame, periods: DataFrame, unit: str) -> DataFrame:
    """Facts with their sentence. ``names(entity_id, entity)`` and ``periods(period_index, label)``."""
    told = facts.join(names, "entity_id").join(periods.select("period_index", "label"), "period_index")
    amount = format_spec_value("value", F.lit(unit))
    text = (F.when(F.col("kind") == "newcomer", F.format_string(
        "%s: first appearance of %s, in place %d (%s).", "label", "entity", "rank", amount))
        .when(F.col("kind") == "jump", F.format_string("%s: %s moves up from place %d to place %d.", "label", "entity", "from_rank", "rank"))
        .otherwise(F.format_string("%s: %s is the new number one (%s).", "label", "entity", amount)))
    return told.withColumn("text", text)


def spotlights(tape: Tape, labels: list[str] | None = None, back: int = 10) -> DataFrame:
    """For each listed period: top three, leader, and who climbed most since ``back`` periods before.

    An entity that was not drawn then counts as ranked top_n + 5. The last listed label reads the final frame.
    """
    labels = list(labels or fixed.SPOTLIGHT_LABELS)
    periods = tape.ranking.periods().filter(F.col("label").isin(labels)).select("period_index", "label")
    steps, last = tape.frames_per_transition, tape.last_moving_frame + tape.frames_per_transition
    frame = F.when(F.col("label") == labels[-1], F.lit(last)).otherwise(F.least(F.col("period_index") * steps, F.lit(last)))
    earlier = F.least(F.greatest(F.lit(0), F.col("period_index") - back) * steps, F.lit(last))
    marks = periods.select("label", frame.cast("bigint").alias("frame_index"), earlier.cast("bigint").alias("earlier_frame"))
    bars = tape.bars(moments="marks").select("frame_index", "entity_id", "rank", "value")
    shown = marks.join(bars, "frame_index")
    then = bars.select(F.col("frame_index").alias("earlier_frame"), "entity_id", F.col("rank").alias("earlier_rank"))
    moved = shown.join(then, ["earlier_frame", "entity_id"], "left")
    gain = F.coalesce("earlier_rank", F.lit(tape.top_n + 5)) - F.col("rank")
    moved = moved.withColumn("gain", gain)
    climbing = F.col("gain") > 0

    def at(rank: int, column: str):
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    best = F.max(F.when(climbing, F.struct("gain", (-F.col("rank")).alias("place"), "entity_id")))
    out = moved.groupBy("label").agg(
        at(1, "entity_id").alias("leader_id"), at(1, "value").alias("leader_value"), at(2, "entity_id").alias("second_id"),
        at(3, "entity_id").alias("third_id"), best.alias("best"))
    return out.select("label", "leader_id", "leader_value", "second_id", "third_id",
                      F.col("best.entity_id").alias("climber_id"), F.col("best.gain").alias("climber_gain"))


def group_totals(bars: DataFrame, groups: DataFrame, n: int = 5) -> DataFrame:
    """Largest group sums in each frame; an entity without a group is under 'Other'."""
    grouped = bars.join(groups.select("entity_id", "group"), "entity_id", "left")
    totals = grouped.groupBy("frame_index", F.coalesce("group", F.lit("Other")).alias("group")).agg(F.sum("value").alias("value"))
    return first_per_group(totals, ["frame_index"], [F.col("value").desc(), F.col("group")], n, "place")


def tape_max(bars: DataFrame) -> DataFrame:
    return bars.agg(F.greatest(F.lit(0.0), F.max("value")).alias("max_value"))


def leaders(boundaries: DataFrame) -> DataFrame:
    return boundaries.filter("rank = 1").select("period_index", "entity_id", "value")


def last_frame_movers(tape: Tape) -> DataFrame:
    end = tape.last_moving_frame + tape.frames_per_transition
    return tape.bars(moments="marks").filter((F.col("frame_index") == end) & F.col("is_mover")).select("entity_id", "rank", "rank_delta")


# --- datasets ------------------------------------------------------------------------------------------------

def dataset_stats(obs: DataFrame) -> DataFrame:
    """One row: observations, distinct entities, rows per status."""
    by_status = {s.lower(): F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)) for s in fixed.STATUSES}
    counts = obs.groupBy("entity_id", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("entity_id").agg(F.sum("n").alias("n"), *[v.alias(k) for k, v in by_status.items()]).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count("*").alias("entities"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in by_status])


def majority_unit(obs: DataFrame) -> DataFrame:
    """One row: the unit most values carry. Ties go to a unit other than count, then to the first seen."""
    from ..functions import clean
    unit = F.coalesce(F.nullif(clean("unit"), F.lit("")), F.lit("count"))
    counts = obs.filter(F.col("value").isNotNull()).groupBy(unit.alias("unit")).agg(
        F.count("*").alias("n"), F.min("ord").alias("ord"))
    nothing = obs.sparkSession.createDataFrame([("count", 0, None)], "unit string, n bigint, ord bigint")
    order = [F.col("n").desc(), (F.col("unit") == "count").asc(), F.col("ord").asc_nulls_last()]
    return counts.unionByName(nothing).orderBy(*order).limit(1).select("unit")


def observed_range(obs: DataFrame) -> DataFrame:
    """One row: first and last year that occur, as labels; null when no date starts with a year."""
    span = obs.select(leading_year("date").alias("y")).agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return span.select(year_label(F.col("low")).alias("start"), year_label(F.col("high")).alias("end"))


def distinct_leaders(obs: DataFrame) -> DataFrame:
    """One row: how many different entities lead some date."""
    value = F.coalesce("value", F.lit(float("-inf")))
    tops = obs.groupBy("date").agg(F.max_by("entity_id", F.struct(value, (-F.col("ord")).alias("o"))).alias("entity_id"))
    return tops.agg(F.count_distinct("entity_id").alias("distinct_leaders"))


def scorecard(obs: DataFrame, source_quality: float) -> DataFrame:
    """One row: eight 0..1 scores of a dataset and their mean."""
    counts = obs.groupBy("date", "entity_id").agg(F.count("*").alias("n"))
    facts = counts.agg(F.sum("n").alias("observations"), F.count_distinct("date").alias("distinct_dates"),
                       F.count_distinct("entity_id").alias("entities"))
    leading = distinct_leaders(obs).scalar()
    facts = facts.withColumns({"distinct_leaders": leading, "source_quality": F.lit(float(source_quality))})
    scores = {name: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(column) / F.lit(float(scale))))
              for name, (column, scale) in fixed.SCORECARD_SCALES.items()}
    scored = facts.select("observations", "distinct_dates", "entities", "distinct_leaders", *[v.alias(k) for k, v in scores.items()])
    total = sum((F.col(k) for k in scores), F.lit(0.0))
    return scored.withColumn("mean_score", total / F.lit(float(len(scores))))


def coverage(obs: DataFrame, source: str = "source") -> DataFrame:
    """Years each source has values for, widest first."""
    spans = obs.filter(F.col("value").isNotNull()).select(F.col(source).alias("source"), leading_year("date").alias("y"))
    ranges = spans.dropna(subset=["y"]).groupBy("source").agg(F.min("y").alias("year_from"), F.max("y").alias("year_to"))
    return ranges.withColumn("span", F.col("year_to") - F.col("year_from")).orderBy(F.col("span").desc(), "source")


def widest_range(obs: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """The source with the widest coverage and the wanted years clamped to what it has."""
    best = coverage(obs).limit(1)
    low = F.col("year_from") if year_from is None else F.greatest(F.lit(year_from), F.col("year_from"))
    high = F.col("year_to") if year_to is None else F.least(F.lit(year_to), F.col("year_to"))
    return best.select("source", "year_from", "year_to", low.alias("use_from"), high.alias("use_to"))


def distinct_sources(obs: DataFrame) -> DataFrame:
    """One row per source url; the publisher seen last stands."""
    return obs.groupBy("source_url").agg(F.max_by("source", "ord").alias("source"))


def publisher_line(obs: DataFrame) -> DataFrame:
    """Distinct publishers in order of first appearance."""
    return obs.groupBy("source").agg(F.min("ord").alias("ord")).orderBy("ord").select("source")
