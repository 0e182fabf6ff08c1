"""From any table of strings to (entity, date, value, unit) drafts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.text import BLANK
from ..functions import cell_names, clean, looks_like_date, matched, scaled_number, strip_corporate_suffix
from .ordering import first_rows

_YEAR_HEADER = re.compile(r"(19|20)\d{2}")
_DATE_HEADER = re.compile("|".join(f"(?:{shape})" for shape in fixed.DATE_SHAPES))


def find_column(df: DataFrame, name: str) -> str | None:
    """Column whose letters and digits equal those of ``name``."""
    def key(s: str) -> str:
        return "".join(ch for ch in s.lower() if ch.isalnum())
    return next((c for c in df.columns if key(c) == key(name)), None)


@dataclass(frozen=True)
class Columns:
    entity: str | None
    date: str | None
    value: str | None
    value_guessed: bool


def numeric_shares(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Share of number cells and of text cells per column of the whole table: one job that returns one row."""
    if not columns:
        return {}
    stats = []
    for i, c in enumerate(columns):
        cell = clean(F.col(f"`{c}`").cast("string"))
        stats += [F.count(F.when(cell != "", F.lit(1))).alias(f"t{i}"),
                  F.count(F.when((cell != "") & scaled_number(cell)["value"].isNotNull(), F.lit(1))).alias(f"n{i}")]
    row = df.agg(*stats).first()
    out = {}
    for i, c in enumerate(columns):
        total, numbers = row[f"t{i}"], row[f"n{i}"]
        out[c] = (numbers / total, (total - numbers) / total) if total else (0.0, 0.0)
    return out


def detect_columns(df: DataFrame) -> Columns:
    """Pick the entity, date and value columns by name, then by what the cells hold."""
    lower = [c.lower() for c in df.columns]

    def named(wanted: tuple[str, ...]) -> str | None:
        return next((c for c, l in zip(df.columns, lower) if l in wanted), None)

    entity, date = named(fixed.ENTITY_COLUMNS), named(fixed.DATE_COLUMNS)
    taken = {c.lower() for c in (entity, date) if c} | set(fixed.RESERVED_COLUMNS)
    shares = numeric_shares(df, [c for c in df.columns if c])
    numeric = sorted((c for c in shares if c.lower() not in taken and shares[c][0] >= 0.5), key=lambda c: -shares[c][0])
    measured = next((c for c in numeric if re.search(fixed.MEASURE_WORDS, c, re.I)), None)
    value = measured or (numeric[0] if numeric else None)
    if entity is None:
        texts = sorted((c for c in shares if c not in (date, value) and shares[c][1] >= 0.5), key=lambda c: -shares[c][1])
        entity = texts[0] if texts else None
    return Columns(entity, date, value, measured is None)


def melt_wide(df: DataFrame, entity: str, unit: str = "count") -> DataFrame:
    """Years as headers: one draft per positive number cell."""
    years = [c for c in df.columns if _YEAR_HEADER.fullmatch(c.strip())]
    text = df.select(strip_corporate_suffix(F.col(f"`{entity}`")).alias("entity"),
                     *[F.regexp_replace(clean(F.col(f"`{c}`").cast("string")), f"[,{BLANK}]", "").alias(c.strip()) for c in years])
    long = text.unpivot("entity", [c.strip() for c in years], "date", "cell").filter("entity != ''")
    value = scaled_number(F.when(~F.col("cell").isin("", "–", "-", "?"), F.col("cell")))["value"]
    return long.select("entity", "date", value.alias("value"), F.lit(unit).alias("unit")).filter("value > 0")


def melt_transposed(df: DataFrame, date: str, unit: str = "count", entities: list[str] | None = None) -> DataFrame:
    """Entities as headers, dates down the rows: one draft per positive number cell."""
    if entities is None:
        free = [c for c in df.columns if c != date and c.strip() and not _DATE_HEADER.fullmatch(c.strip())]
        shares = numeric_shares(df, free)
        entities = [c for c in free if shares[c][0] >= 0.5]
        if len(entities) < 2:
            raise ValueError(f"a table with entities as headers needs two number columns at least, found {entities}")
    text = df.select(clean(F.col(f"`{date}`").cast("string")).alias("date"),
                     *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in entities])
    long = text.unpivot("date", [c.strip() for c in entities], "entity", "cell").filter(looks_like_date("date"))
    parsed = scaled_number("cell")
    return long.select("entity", "date", parsed["value"].alias("value"),
                       F.coalesce(parsed["unit_hint"], F.lit(unit)).alias("unit")).filter("value > 0")


def long_drafts(df: DataFrame, entity: str, date: str, value: str, unit: str = "count") -> DataFrame:
    """Every row with its draft columns and the reason it is skipped, if any. A bad number is kept as null."""
    name, day = strip_corporate_suffix(F.col(f"`{entity}`").cast("string")), clean(F.col(f"`{date}`").cast("string"))
    parsed = scaled_number(F.col(f"`{value}`").cast("string"))
    blank = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(day, F.lit("")) == "")
    skipped = F.when(blank, F.lit("blank")).when(~looks_like_date(day), F.lit("bad date"))
    extra = [c for c in ("ord",) if c in df.columns]
    return df.select(*extra, name.alias("entity"), day.alias("date"), parsed["value"].alias("value"),
                     F.coalesce(parsed["unit_hint"], F.lit(unit)).alias("unit"), skipped.alias("skipped"))


def skip_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.when(F.col("skipped").isNull(), F.lit(1))).alias("kept"),
                      F.count(F.when(F.col("skipped") == "blank", F.lit(1))).alias("skipped_blank"),
                      F.count(F.when(F.col("skipped") == "bad date", F.lit(1))).alias("skipped_bad_date"))


def drafts_from_table(df: DataFrame, unit: str = "count") -> DataFrame:
    """Drafts of a table of any of the three shapes; an unrecognised table is an error."""
    found = detect_columns(df)
    if found.entity and found.date and found.value:
        return long_drafts(df, found.entity, found.date, found.value, unit).filter("skipped is null").drop("skipped")
    years = [c for c in df.columns if _YEAR_HEADER.fullmatch(c.strip())]
    name = next((c for c in df.columns if c.lower().strip() in fixed.WIDE_ENTITY_COLUMNS), None)
    if name and len(years) >= 2:
        return melt_wide(df, name, unit)
    if not found.entity and found.date:
        return melt_transposed(df, found.date, unit)
    raise ValueError(f"could not identify entity, date and value columns in {df.columns}")


def explode_names(df: DataFrame, column: str) -> DataFrame:
    """One row per name in a cell, company forms stripped."""
    return df.withColumn(column, F.explode(F.transform(cell_names(column), strip_corporate_suffix)))


def name_year_rows(df: DataFrame, entity: str, date: str, value: str, hint: Column | None = None) -> DataFrame:
    """(entity, date, value) rows with the date cut to its year; unusable rows are left out."""
    year = matched(F.col(date).cast("string"), r"(-?\d{1,5})", 1)
    parsed = scaled_number(F.col(value).cast("string"))["value"]
    more = [] if hint is None else [hint.alias("hint")]
    rows = df.select(F.col(entity).cast("string").alias("_cell"), year.alias("date"), parsed.alias("value"), *more)
    # Unusable rows have no names. A filter would be pushed below and parse every number twice.
    names = F.when(F.col("date").isNotNull() & (F.col("value") > 0), F.transform(cell_names("_cell"), strip_corporate_suffix))
    return rows.select(F.explode(names).alias("entity"), "date", "value", *(["hint"] if more else []))


def sum_by_name_year(df: DataFrame, entity: str, date: str, value: str, keep: int | None = None) -> DataFrame:
    """Sums per (name, year), or the ``keep`` largest of them, in order."""
    sums = name_year_rows(df, entity, date, value).groupBy("entity", "date").agg(F.sum("value").alias("value"))
    if keep is None:
        return sums
    return first_rows(sums, [F.col("value").desc(), F.col("entity"), F.col("date")], keep)


def name_table_drafts(df: DataFrame, unit: str = "count") -> DataFrame:
    """(entity, date, value, unit) of a table of names, years and amounts, whose name cells may be lists.

    The date column may have any header that speaks of a date or year, as long as some cell reads as one. A column of
    people whose cells list several names goes before the entity column found otherwise. If any cell lists several names,
    amounts are summed per name and year; else every usable row is a draft of its own. One pass decides, over all rows.
    """
    found = detect_columns(df)
    dates = [c for c in df.columns if re.search("date|year", c, re.I)] if found.date is None else []
    people = [c for c in df.columns if re.search(fixed.PERSON_COLUMN_WORDS, c, re.I)]
    lists = list(dict.fromkeys([*people, *([found.entity] if found.entity else [])]))
    cell = lambda c: F.col(f"`{c}`").cast("string")
    facts = df.agg(F.lit(0).alias("_"), *[F.count(F.when(looks_like_date(cell(c)), 1)).alias(f"d{i}") for i, c in enumerate(dates)],
                   *[F.count(F.when(F.size(cell_names(cell(c))) >= 2, 1)).alias(f"l{i}") for i, c in enumerate(lists)]).first()
    date = found.date or next((c for i, c in enumerate(dates) if facts[f"d{i}"]), None)
    several = {c: bool(facts[f"l{i}"]) for i, c in enumerate(lists)}
    entity = next((c for c in people if several[c]), found.entity)
    if not (entity and date and found.value):
        raise ValueError(f"could not identify entity, date and value columns in {df.columns}")
    if several[entity]:
        return sum_by_name_year(df, entity, date, found.value).withColumn("unit", F.lit(unit))
    rows = name_year_rows(df.select(cell(entity).alias("e"), cell(date).alias("d"), cell(found.value).alias("v")), "e", "d", "v", hint=scaled_number("v")["unit_hint"])
    return rows.withColumn("unit", F.coalesce("hint", F.lit(unit))).drop("hint")


def year_end_values(points: DataFrame, scale: float = 1e5) -> DataFrame:
    """Last point of each UTC year 1900..2100 per entity. ``points(entity, ts in seconds, m)``."""
    year = F.year(F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")))  # UTC whatever the session's zone
    kept = points.withColumn("year", year).filter("year between 1900 and 2100")
    last = kept.groupBy("entity", "year").agg(F.max_by("m", "ts").alias("m"))
    return last.select("entity", "year", F.floor(F.col("m") * scale + 0.5).cast("double").alias("value"))


def year_span(df: DataFrame) -> DataFrame:
    """One row: first and last year of a table, from its year headers, its year column, or its cells."""
    heads = sorted(int(c.strip()) for c in df.columns if re.fullmatch(r"\d{4}", c.strip()) and 1000 <= int(c.strip()) <= 2100)
    if len(heads) >= 2:
        return df.sparkSession.createDataFrame([(heads[0], heads[-1])], "year_min int, year_max int")
    named = [c for c in df.columns if c.strip().lower() in ("year", "date")][:1]

    def year(c: str) -> Column:
        y = matched(clean(F.col(f"`{c}`").cast("string")), r"^(-?\d{1,5})$", 1).cast("int")
        return F.when(y.between(-20000, 2100), y)

    low = [year(c) for c in (named or df.columns)]
    first = F.least(*low) if len(low) > 1 else low[0]
    last = F.greatest(*low) if len(low) > 1 else low[0]
    return df.agg(F.min(first).alias("year_min"), F.max(last).alias("year_max"))
