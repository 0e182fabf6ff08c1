"""Cross-source verification: agree, disagree, or stand alone. Values are never averaged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import canonical_key, parse_date, publisher_key, unit_word
from ..session import write_stage
from .ordering import with_previous

CELL = ["canonical", "date", "base_unit"]


def with_cell(obs: DataFrame) -> DataFrame:
    """Add the comparison cell (canonical name, base unit), the scale of the unit word, and the publisher key."""
    word = unit_word("unit")
    return obs.withColumns({"canonical": canonical_key("entity"), "base_unit": word["base"],
                            "multiplier": word["multiplier"], "publisher": publisher_key("source", "source_url")})


def primary_sources(obs: DataFrame, expected_unit: str | None = None) -> DataFrame:
    """Publishers in order of preference: matching unit, most distinct cells, mean confidence, first seen."""
    keyed = obs.select("ord", "source", "source_url", "confidence", "unit", "date", canonical_key("entity").alias("canonical"),
                       publisher_key("source", "source_url").alias("publisher"))
    matches = F.lit(False)
    if expected_unit:
        unit, want = F.lower("unit"), F.lit(expected_unit.lower())
        matches = F.coalesce((unit != "") & (unit.contains(want) | want.contains(unit)), F.lit(False))
    # One row per (publisher, cell) first: the distinct count then needs no wide expansion, and a publisher that
    # holds much of the data is combined in the map tasks.
    cells = keyed.groupBy("publisher", "canonical", "date").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.max(matches).alias("unit_match"), F.min("ord").alias("ord"),
        F.min_by(F.struct("source", "source_url"), "ord").alias("shown"))
    ranked = cells.groupBy("publisher").agg(
        F.max("unit_match").alias("unit_match"), F.count("*").alias("cells"), F.sum("n").alias("observations"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"), F.min("ord").alias("first_ord"),
        F.min_by("shown", "ord").alias("shown"))
    return ranked.select("publisher", F.col("shown.source").alias("source"), F.col("shown.source_url").alias("source_url"),
                         "unit_match", "cells", "observations", "mean_confidence", "first_ord")


def preference() -> list[Column]:
    return [F.col("unit_match").desc(), F.col("cells").desc(), F.col("mean_confidence").desc(), F.col("first_ord")]


def unit_mismatches(obs: DataFrame) -> DataFrame:
    """(entity, date) reported in more than one base unit, with the number of units."""
    cells = obs.filter(F.col("value").isNotNull()).select(
        canonical_key("entity").alias("canonical"), "date", unit_word("unit")["base"].alias("base_unit")).distinct()
    return cells.groupBy("canonical", "date").agg(F.count("*").alias("units")).filter("units > 1")


@dataclass
class Verification:
    """Decided observations, the conflicting cells, each conflict's candidates, and the cells dropped."""

    observations: DataFrame
    conflicts: DataFrame
    candidates: DataFrame
    dropped: DataFrame
    primary: DataFrame | None


def verify_across_sources(obs: DataFrame, tolerance: float = 0.05, single_source: bool = False,
                          expected_unit: str | None = None) -> Verification:
    """Compare independent publishers inside each (entity, date, base unit) cell.

    One aggregation, written out, decides every cell. A cell with one row passes. Two or more independent publishers within
    ``tolerance`` make its first (or primary) row VERIFIED. Repeats of one publisher keep the first row. Otherwise
    the cell conflicts: all of its rows are CONFLICTING, or the primary publisher's row stands in single-source
    mode. ``ord`` is unique. Rows without a value are appended unchanged. Candidates of a conflict stay rows of a table; they are not
    gathered into one list, because one cell may hold any number of them.
    """
    columns = obs.columns
    celled = with_cell(obs)
    primary = None
    if single_source:
        primary = primary_sources(obs, expected_unit).orderBy(*preference()).limit(1)
        celled = celled.withColumn("is_primary", F.col("publisher") == primary.select("publisher").scalar())
    else:
        celled = celled.withColumn("is_primary", F.lit(True))
    valued = celled.filter(F.col("value").isNotNull())
    scaled = F.col("value") * F.col("multiplier")
    # A row per (cell, publisher) first: counts publishers without a distinct, and a cell in which one publisher
    # repeats itself without end shrinks in the map tasks. Buffers are numbers only, so this is a hash aggregation; the
    # chosen rows are joined back by their ord.
    voices = valued.groupBy(*CELL, "publisher").agg(
        F.count("*").alias("n"), F.min(scaled).alias("low"), F.max(scaled).alias("high"), F.min("ord").alias("ord"),
        F.min_by("multiplier", "ord").alias("multiplier"),
        F.min(F.when(F.col("is_primary"), F.col("ord"))).alias("kept_ord"))
    decided = voices.groupBy(*CELL).agg(
        F.sum("n").alias("n"), F.count("*").alias("publishers"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min_by("multiplier", "ord").alias("unit_scale"),
        F.min("ord").alias("first_ord"), F.min("kept_ord").alias("kept_ord"))
    low, high = F.col("low") / F.col("unit_scale"), F.col("high") / F.col("unit_scale")
    spread = (high - low) / F.greatest(F.abs(high), F.abs(low), F.lit(1e-9))
    decided = decided.withColumn("spread", spread).withColumn("outcome", F.when(
        F.col("kept_ord").isNull(), F.lit("dropped")).when(F.col("n") == 1, F.lit("single"))
        .when((F.col("spread") <= tolerance) & (F.col("publishers") >= 2), F.lit("verified"))
        .when(F.col("publishers") < 2, F.lit("repeated")).otherwise(F.lit("conflict")))
    # One row per cell, written once: the observations, conflicts and dropped cells below all read it.
    decided = write_stage(decided, "verified-cells")
    agreed = F.col("outcome") == "verified"
    trust = F.least(F.lit(0.98), F.lit(0.75) + F.lit(0.05) * F.col("publishers"))
    stands = decided.filter(F.col("outcome") != "dropped")
    if not single_source:
        stands = stands.filter(F.col("outcome") != "conflict")
    stands = stands.select(*CELL, F.col("kept_ord").alias("ord"), agreed.alias("_agreed"), trust.alias("_trust"))
    kept = valued.join(stands, [*CELL, "ord"])
    kept = kept.withColumns({"status": F.when(F.col("_agreed"), F.lit("VERIFIED")).otherwise(F.col("status")),
                             "confidence": F.when(F.col("_agreed"), F.col("_trust")).otherwise(F.col("confidence"))})
    kept = kept.withColumn("entity_id", F.col("canonical")).select(*columns)
    clashes = decided.filter(F.col("outcome") == "conflict").select(
        *CELL, "n", "publishers", low.alias("low"), high.alias("high"), "spread", "first_ord")
    candidates = valued.join(clashes.select(*CELL), CELL, "left_semi").select(*CELL, "ord", "value", "source_url", "status")
    empty = celled.filter(F.col("value").isNull() & F.col("is_primary")).withColumn("entity_id", F.col("canonical"))
    result = kept.unionByName(empty.select(*columns))
    if not single_source:
        disputed = valued.join(clashes.select(*CELL), CELL, "left_semi").withColumns(
            {"entity_id": F.col("canonical"), "status": F.lit("CONFLICTING")})
        result = result.unionByName(disputed.select(*columns))
    dropped = decided.filter(F.col("outcome") == "dropped").select(*CELL, "n", "first_ord")
    return Verification(result, clashes, candidates, dropped, primary)


def outlier_jumps(obs: DataFrame, ratio: float = 100.0, by_unit: bool = False) -> DataFrame:
    """Consecutive values of one entity that differ by ``ratio`` or more either way, in time order.

    Needs entity_id and sort_key. A series may hold any share of the rows, so this does not use a window over it.
    """
    series = obs.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    keys = ["entity_id"]
    if by_unit:
        series, keys = series.withColumn("base_unit", unit_word("unit")["base"]), ["entity_id", "base_unit"]
    series = series.select(*keys, "sort_key", "ord", "date", "value")
    paired = with_previous(series, keys, [F.col("sort_key").asc_nulls_first(), F.col("ord")],
                           F.struct("date", "value"), "before", name="series")
    times = F.abs("value") / F.abs(F.col("before.value"))
    jumps = paired.withColumn("ratio", times).filter((F.col("ratio") >= ratio) | (F.col("ratio") <= 1.0 / ratio))
    return jumps.select(*keys, "ord", F.col("before.date").alias("from_date"), F.col("before.value").alias("from_value"),
                        F.col("date").alias("to_date"), F.col("value").alias("to_value"), "ratio")


def conflict_records(result: Verification, metric: str) -> DataFrame:
    """Conflicts as records: id, metric, entity, date, unit, reason, number of candidates, and whether a row stands in spite of them.

    ``resolved`` is true in single-source mode, where the primary publisher's row is kept. The candidates are rows of
    ``result.candidates`` with the same cell.
    """
    reason = F.concat(F.col("publishers").cast("string"), F.lit(" publishers differ by "), F.round(F.col("spread") * 100, 1).cast("string"), F.lit(" %"))
    return result.conflicts.select(
        F.concat_ws("_", F.lit("conflict"), F.sha1(F.concat_ws("|", F.lit(metric), *CELL))).alias("conflict_id"), F.lit(metric).alias("metric"),
        F.col("canonical").alias("entity_id"), "date", F.col("base_unit").alias("unit"), reason.alias("reason"), F.col("n").alias("candidates"),
        F.lit(result.primary is not None).alias("resolved"))


def verification_notes(obs: DataFrame, result: Verification, outlier_ratio: float = 100.0) -> DataFrame:
    """(kind, entity_id, date, detail): what a reader of the result should know, one row per finding.

    Kinds: cells told in several units, disputed cells, cells the primary publisher does not have, and jumps of
    ``outlier_ratio`` or more between consecutive values of the result.
    """
    def note(kind: str, rows: DataFrame, entity: str, date: str, detail: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(entity).alias("entity_id"), F.col(date).alias("date"), detail.alias("detail"))

    timed = result.observations.withColumn("sort_key", parse_date("date")["sort_key"])
    jumps = outlier_jumps(timed, outlier_ratio)
    return (note("unit mismatch", unit_mismatches(obs), "canonical", "date", F.concat(F.col("units").cast("string"), F.lit(" units")))
            .unionByName(note("dispute", result.conflicts, "canonical", "date", F.concat(F.col("n").cast("string"), F.lit(" values of "), F.col("publishers").cast("string"), F.lit(" publishers"))))
            .unionByName(note("not from primary", result.dropped, "canonical", "date", F.concat(F.col("n").cast("string"), F.lit(" values left out"))))
            .unionByName(note("outlier", jumps, "entity_id", "to_date", F.concat(F.lit("since "), F.col("from_date")))))


def verification_summary(result: Verification) -> DataFrame:
    """One row: counts per status, corroborated and single-publisher values, conflicts."""
    def having(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, F.lit(1)))

    conflicts = result.conflicts.agg(F.count("*")).scalar()
    valued = F.col("value").isNotNull()
    counts = result.observations.agg(
        F.count("*").alias("observations"), having("VERIFIED").alias("verified"), having("SUPPORTED").alias("supported"),
        having("UNKNOWN").alias("unknown"), having("CONFLICTING").alias("conflicting"),
        having("REJECTED").alias("rejected"), F.count("value").alias("valued"),
        F.count(F.when(valued & (F.col("status") == "SUPPORTED"), F.lit(1))).alias("single_publisher"))
    return counts.select("*", conflicts.alias("conflicts"))
