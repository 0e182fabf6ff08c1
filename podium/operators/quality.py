"""Data-quality checks. Each check is a table of violations ``(check, detail, n)``; the report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions import canonical_key, clean, normalize_unit, parse_date, slugify, unit_word
from .entities import resolve_entities
from ..session import write_stage
from .verify import outlier_jumps, unit_mismatches

CORE_CHECKS = ("schema", "type", "date", "unit", "entity", "duplicate", "range", "source", "temporal", "ranking",
               "rank-as-value", "citation")
#: What ``core_violations`` runs when it is given no ranking.
UNRANKED_CHECKS = tuple(c for c in CORE_CHECKS if c != "ranking")
PLATFORM_CHECKS = ("schema", "type", "date", "unit", "range", "source", "temporal", "citation", "duplicate",
                   "unit-mismatch", "outlier", "rank-as-value", "ranking")


def _found(check: str, rows: DataFrame, detail: Column, n: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"),
                       (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def _blank(name: str) -> Column:
    return F.coalesce(clean(name), F.lit("")) == ""


def _is_number(v: str = "value") -> Column:
    return F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def _problem(check: str, bad: Column, detail: Column) -> Column:
    return F.when(bad, F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))


def row_violations(obs: DataFrame, *problems: Column) -> DataFrame:
    """All row-level checks in one pass: a row yields one violation per problem it has."""
    return obs.select(F.inline(F.array_compact(F.array(*problems)))).withColumn("n", F.lit(1).cast("bigint"))


def _empty_entity() -> Column:
    return _problem("schema", _blank("entity"), F.concat_ws(" ", "ord", F.lit("empty entity")))


def _empty_date() -> Column:
    return _problem("schema", _blank("date"), F.concat_ws(" ", "ord", F.lit("empty date")))


def _type() -> Column:
    return _problem("type", F.col("value").isNotNull() & ~_is_number(), F.col("ord"))


def _date(key: Column) -> Column:
    return _problem("date", key.isNull(), F.concat_ws(" ", "ord", "date"))


def _date_normalised() -> Column:
    return _problem("date", ~F.col("date").rlike(fixed.NORMALISED_DATE), F.concat_ws(" ", "ord", "date"))


def _unit(known: Column, dataset_unit: str | None) -> Column:
    return _problem("unit", F.coalesce(~known, F.lit(dataset_unit is None)), F.concat_ws(" ", "ord", "unit"))


def _unit_present() -> Column:
    return _problem("unit", _blank("unit"), F.col("ord"))


def _range(dimension: Column) -> Column:
    counts = F.coalesce(dimension, F.lit("count")) == "count"
    return _problem("range", counts & (F.col("value") < 0), F.concat_ws(" ", "ord", "value"))


def _range_count() -> Column:
    return _problem("range", (F.col("unit") == "count") & (F.col("value") < 0), F.col("ord"))


def _source() -> Column:
    nowhere = F.col("source").isNull() & F.col("source_url").isNull()
    malformed = F.col("source_url").isNotNull() & ~F.col("source_url").rlike("^(http|file:|upload:)")
    return _problem("source", nowhere | malformed, F.concat_ws(" ", "ord", "source_url"))


def _source_url() -> Column:
    return _problem("source", F.coalesce("source_url", F.lit("")) == "", F.col("ord"))


def _temporal(key: Column, max_date: str) -> Column:
    flagged = F.coalesce(F.lower("status").isin("forecast", "estimated"), F.lit(False))
    return _problem("temporal", (key > parse_date(F.lit(max_date))["sort_key"]) & ~flagged, F.concat_ws(" ", "ord", "date"))


def _temporal_text(max_date: str) -> Column:
    return _problem("temporal", F.substring("date", 1, 10) > max_date, F.concat_ws(" ", "ord", "date"))


def _citation_each() -> Column:
    return _problem("citation", F.col("value").isNotNull() & (F.coalesce("source", F.lit("")) == ""), F.col("ord"))


def _null_status() -> Column:
    return _problem("null-status", F.col("value").isNull() & ~F.coalesce(F.col("status") == "UNKNOWN", F.lit(False)), F.col("ord"))


def _no_rows(obs: DataFrame) -> DataFrame:
    none = obs.limit(1).agg(F.count("*").alias("rows")).filter("rows = 0")
    return _found("schema", none, F.lit("no observations present"))


def _sort_key() -> Column:
    return parse_date("date")["sort_key"]


def check_schema(obs: DataFrame) -> DataFrame:
    """A blank entity and a blank date count one each; so does an empty dataset."""
    return row_violations(obs, _empty_entity(), _empty_date()).unionByName(_no_rows(obs))


def check_type(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _type())


def check_date(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _date(_sort_key()))


def check_date_normalised(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _date_normalised())


def check_unit(obs: DataFrame, dataset_unit: str | None = None) -> DataFrame:
    return row_violations(obs, _unit(normalize_unit("unit")["known"], dataset_unit))


def check_unit_present(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _unit_present())


def check_entity(obs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """One violation in all when some entity name could mean several dictionary entries."""
    names = obs.groupBy(slugify("entity").alias("slug")).agg(F.min("entity").alias("entity"))
    unclear = resolve_entities(names, "entity", dictionary).filter(F.col("resolution") == "ambiguous")
    return _found("entity", unclear.agg(F.count("*").alias("names")).filter("names > 0"), F.col("names"))


def check_duplicate(obs: DataFrame) -> DataFrame:
    """Extra rows of an (entity, written date) cell, counted per cell by aggregation."""
    cells = obs.groupBy(slugify("entity").alias("slug"), "date").agg(F.count("*").alias("rows")).filter("rows > 1")
    return _found("duplicate", cells, F.concat_ws(" / ", "slug", "date"), F.col("rows") - 1)


def check_duplicate_cells(obs: DataFrame) -> DataFrame:
    """Cells (entity, date, base unit) with several rows, unless all of them are marked as conflicting."""
    cells = obs.groupBy(canonical_key("entity").alias("canonical"), "date", unit_word("unit")["base"].alias("base_unit")).agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("status") == "CONFLICTING", F.lit(1))).alias("disputed"))
    return _found("duplicate", cells.filter("rows > 1 and disputed < rows"), F.concat_ws("|", "canonical", "date", "base_unit"))


def check_range(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _range(normalize_unit("unit")["dimension"]))


def check_range_count(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _range_count())


def check_source(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _source())


def check_source_url(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _source_url())


def check_temporal(obs: DataFrame, max_date: str) -> DataFrame:
    """Dates after ``max_date`` without a forecast or estimated flag."""
    return row_violations(obs, _temporal(_sort_key(), max_date))


def check_temporal_text(obs: DataFrame, max_date: str) -> DataFrame:
    return row_violations(obs, _temporal_text(max_date))


def check_ranking(ranked: DataFrame) -> DataFrame:
    """Periods whose ranks are not exactly 1..n. ``ranked`` has sort_key and rank."""
    periods = ranked.groupBy("sort_key").agg(
        F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.sum("rank").alias("total"))
    wrong = (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("total") != F.col("n") * (F.col("n") + 1) / 2)
    return _found("ranking", periods.filter(wrong), F.col("sort_key"))


def check_rejected(obs: DataFrame) -> DataFrame:
    bad = obs.filter(F.col("value").isNotNull() & (F.col("status") == "REJECTED")).limit(1)
    return _found("ranking", bad, F.lit("rejected values are present"))


def rank_columns_as_values(obs: DataFrame, least: int = 5) -> DataFrame:
    """Dates whose values are exactly 1..n for n >= ``least``: a rank column was read as the measure.

    Values are made distinct first, so a date with very many rows is combined in the map tasks.
    """
    return _rank_dates(obs.filter(_is_number()).groupBy("date", "value").agg(F.count("*").alias("rows")), least)


def _rank_dates(values: DataFrame, least: int) -> DataFrame:
    """Dates whose (date, value, rows) are 1..n, each once."""
    whole = F.col("value") == F.floor("value")
    dates = values.groupBy("date").agg(
        F.sum("rows").alias("n"), F.count("*").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.when(~whole, F.lit(1))).alias("broken"))
    return dates.filter(f"n >= {least} and distinct = n and low = 1 and high = n and broken = 0").select("date", "n")


def check_rank_as_value(obs: DataFrame) -> DataFrame:
    return _found("rank-as-value", rank_columns_as_values(obs), F.concat_ws(" 1..", "date", "n"))


def check_citation(obs: DataFrame) -> DataFrame:
    """One violation in all when there are values but none of them has a source."""
    cited = F.count(F.when(F.col("source").isNotNull() | F.col("source_url").isNotNull(), F.lit(1)))
    totals = obs.filter(F.col("value").isNotNull()).agg(F.count("*").alias("valued"), cited.alias("cited"))
    return _found("citation", totals.filter("valued > 0 and cited = 0"), F.col("valued"))


def check_citation_each(obs: DataFrame) -> DataFrame:
    return row_violations(obs, _citation_each())


def check_unit_mismatch(obs: DataFrame) -> DataFrame:
    return _found("unit-mismatch", unit_mismatches(obs), F.concat_ws("|", "canonical", "date"))


def check_outlier(obs: DataFrame) -> DataFrame:
    keyed = obs.withColumns({"entity_id": canonical_key("entity"), "sort_key": parse_date("date")["sort_key"]})
    return _found("outlier", outlier_jumps(keyed, by_unit=True), F.concat_ws(" ", "entity_id", "from_date", "to_date"))


def check_money(meta: DataFrame) -> DataFrame:
    """Datasets (metric, unit) that measure money in a count-like unit."""
    wrong = F.col("metric").rlike("(?i)" + fixed.MONEY_METRIC) & F.lower(clean("unit")).isin(*fixed.COUNT_LIKE_UNITS)
    return _found("money", meta.filter(wrong), F.concat_ws(" / ", "metric", "unit"))


def check_multi_value(obs: DataFrame) -> DataFrame:
    """One violation when at least half of the distinct entity names hold a comma."""
    names = obs.select(clean("entity").alias("name")).filter("name != ''").distinct()
    counts = names.agg(F.count("*").alias("names"), F.count(F.when(F.col("name").contains(","), F.lit(1))).alias("lists"))
    return _found("multi-value", counts.filter("names > 0 and lists * 2 >= names"), F.concat_ws(" of ", "lists", "names"))


def check_null_status(obs: DataFrame) -> DataFrame:
    """Rows without a value that are not marked UNKNOWN."""
    return row_violations(obs, _null_status())


def core_violations(obs: DataFrame, max_date: str, dataset_unit: str | None = None, ranked: DataFrame | None = None,
                    dictionary: DataFrame | None = None) -> DataFrame:
    """Violations of the core checks. Pass ``ranked`` (sort_key, rank) to include the ranking check.

    The seven row-level checks share one pass, in which a date and a unit are parsed once. Checks about groups
    add one aggregation each, over the few columns they need.
    """
    parsed = obs.withColumns({"_key": _sort_key(), "_unit": normalize_unit("unit")})
    rows = row_violations(parsed, _empty_entity(), _empty_date(), _type(), _date(F.col("_key")), _unit(F.col("_unit.known"), dataset_unit),
                          _range(F.col("_unit.dimension")), _source(), _temporal(F.col("_key"), max_date))
    found = [rows, _no_rows(obs), check_entity(obs, dictionary), check_duplicate(obs), check_rank_as_value(obs), check_citation(obs)]
    if ranked is not None:
        found.append(check_ranking(ranked))
    return reduce(DataFrame.unionByName, found)


def core_counts(obs: DataFrame, max_date: str, dataset_unit: str | None = None, ranked: DataFrame | None = None,
                dictionary: DataFrame | None = None) -> DataFrame:
    """Violations per core check (check, detail, n), one row each at most, from a single scan of the observations.

    ``core_violations`` lists every violation and scans once per check about groups. Here the rows are counted once per written
    (entity, date, value, unit) with numeric buffers and written; every check reads that table, and dates, units and
    names are parsed once per spelling. Counters of tasks (``observe``) would count a repeated map task twice.
    """
    count = lambda condition: F.count(F.when(condition, F.lit(1)))
    flagged = F.lower("status").isin("forecast", "estimated")
    cells = write_stage(obs.groupBy("entity", "date", "value", "unit").agg(
        F.count("*").alias("rows"), count(flagged).alias("flagged"), count(_source().isNotNull()).alias("sourceless"),
        count(F.col("source").isNotNull() | F.col("source_url").isNotNull()).alias("cited")), "check-cells")
    total = lambda condition, n="rows": F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0))
    valued = F.col("value").isNotNull()
    whole = cells.agg(
        F.count("*").alias("cells"), (total(_blank("entity")) + total(_blank("date"))).alias("blank"), total(valued & ~_is_number()).alias("type"),
        total(F.lit(True), "sourceless").alias("source"), total(valued).alias("valued"), total(valued, "cited").alias("cited"))
    dates = cells.groupBy("date").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("flagged")).alias("open"))
    dates = dates.withColumn("_key", _sort_key()).agg(
        total(F.col("_key").isNull()).alias("date"), total(F.col("_key") > parse_date(F.lit(max_date))["sort_key"], "open").alias("temporal"))
    units = cells.groupBy("unit").agg(F.sum("rows").alias("rows"), total(F.col("value") < 0).alias("below")).withColumn("_unit", normalize_unit("unit"))
    units = units.agg(total(F.coalesce(~F.col("_unit.known"), F.lit(dataset_unit is None))).alias("unit"),
                      total(F.coalesce("_unit.dimension", F.lit("count")) == "count", "below").alias("range"))
    named = cells.groupBy("entity", "date").agg(F.sum("rows").alias("rows")).groupBy(slugify("entity").alias("slug"), "date").agg(F.sum("rows").alias("rows"))
    values = cells.filter(_is_number()).groupBy("date", "value").agg(F.sum("rows").alias("rows"))
    of = lambda table, check, n: table.select(F.lit(check).alias("check"), F.lit(None).cast("string").alias("detail"), n.cast("bigint").alias("n"))
    schema = F.col("blank") + F.when(F.col("cells") == 0, F.lit(1)).otherwise(F.lit(0))
    uncited = F.when((F.col("valued") > 0) & (F.col("cited") == 0), F.lit(1)).otherwise(F.lit(0))
    found = [of(whole, "schema", schema), of(whole, "type", F.col("type")), of(whole, "source", F.col("source")), of(whole, "citation", uncited),
             of(dates, "date", F.col("date")), of(dates, "temporal", F.col("temporal")), of(units, "unit", F.col("unit")), of(units, "range", F.col("range")),
             of(named.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n")), "duplicate", F.col("n")),
             of(_rank_dates(values, 5).agg(F.count("*").alias("n")), "rank-as-value", F.col("n")),
             check_entity(cells.select("entity").distinct(), dictionary)]
    if ranked is not None:
        found.append(check_ranking(ranked))
    return reduce(DataFrame.unionByName, found)


def platform_violations(obs: DataFrame, max_date: str) -> DataFrame:
    """Violations of the checks on verified datasets; the row-level ones share one pass."""
    rows = row_violations(obs, _type(), _date_normalised(), _unit_present(), _range_count(), _source_url(), _temporal_text(max_date), _citation_each())
    found = [rows, _no_rows(obs), check_duplicate_cells(obs), check_unit_mismatch(obs), check_outlier(obs), check_rank_as_value(obs),
             check_rejected(obs)]
    return reduce(DataFrame.unionByName, found)


def quality_report(violations: DataFrame, checks: tuple[str, ...] = UNRANKED_CHECKS) -> DataFrame:
    """One row per check: violations and whether it passed. ``checks`` are those that ran; they are listed without violations, too.

    The listed checks are appended as zero-count rows, so the roll-up is one small aggregation.
    """
    listed = violations.sparkSession.createDataFrame([(c, None, 0) for c in checks], "check string, detail string, n bigint")
    totals = violations.unionByName(listed).groupBy("check").agg(F.sum("n").alias("violations"))
    return totals.withColumn("passed", F.col("violations") == 0)


def report_totals(report: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: observations, entities, violations, passed."""
    counts = obs.select(slugify("entity").alias("slug")).groupBy("slug").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count("*").alias("entities"))
    counts = counts.select("*", report.agg(F.sum("violations")).scalar().alias("violations"))
    return counts.withColumn("passed", F.col("violations") == 0)


def gate(obs: DataFrame, frames: DataFrame, report: DataFrame) -> DataFrame:
    """Findings that block approval: no rows, no frames, unmarked nulls, blank names, failed checks."""
    no_frames = frames.limit(1).agg(F.count("*").alias("rows")).filter("rows = 0")
    failed = report.filter(~F.col("passed"))
    blank = obs.filter(_blank("entity"))
    return (_found("gate", _no_rows(obs), F.col("detail"))
            .unionByName(_found("gate", no_frames, F.lit("no frames")))
            .unionByName(_found("gate", check_null_status(obs), F.concat(F.lit("null not UNKNOWN: "), F.col("detail"))))
            .unionByName(_found("gate", blank, F.concat(F.lit("blank name: "), F.col("ord").cast("string"))))
            .unionByName(_found("gate", failed, F.concat(F.lit("failed check: "), F.col("check")))))
