"""Row-level cleaning, normalisation and revision of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (ascii_slug, clean, convert_known, infer_frequency, normalize_unit, parse_date)
from .entities import resolve_entities
from .ordering import first_per_group

OBSERVATION_DEFAULTS = {"frequency": "string", "geography": "string", "status": "string", "confidence": "double",
                        "unit": "string", "source": "string", "source_url": "string", "method": "string"}


def with_observation_columns(df: DataFrame) -> DataFrame:
    """Add the optional observation columns that are absent, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in OBSERVATION_DEFAULTS.items() if c not in df.columns})


def drop_reason() -> Column:
    """Why an observation cannot be trusted, or null."""
    blank = (F.coalesce(clean("entity"), F.lit("")) == "") | (F.coalesce(clean("date"), F.lit("")) == "")
    infinite = F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    negative = (F.col("value") < 0) & F.coalesce(F.col("unit").rlike("(?i)count"), F.lit(False))
    return (F.when(blank, F.lit("missing entity or date"))
            .when(F.col("value").isNotNull() & infinite, F.lit("non-finite value"))
            .when(F.col("value").isNotNull() & negative, F.lit("negative count")))


def sanitize(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason)."""
    marked = obs.withColumn("reason", drop_reason())
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def build_observations(rows: DataFrame, default_unit: str = "count") -> DataFrame:
    """Complete rows to observations: a missing value is null and UNKNOWN, ids and frequency are derived.

    The id is built from ``ord``, so it needs no numbering pass over the data.
    """
    rows = with_observation_columns(rows)
    value = F.when(~F.isnan("value"), F.col("value"))
    entity_id = F.col("entity_id") if "entity_id" in rows.columns else F.lit(None).cast("string")
    number = F.col("ord").cast("string")
    padded = F.when(F.length(number) >= 5, number).otherwise(F.lpad(number, 5, "0"))
    return rows.withColumns({
        "value": value,
        "status": F.when(value.isNull(), F.lit("UNKNOWN")).otherwise(F.coalesce("status", F.lit("SUPPORTED"))),
        "entity_id": F.coalesce(entity_id, ascii_slug("entity")),
        "observation_id": F.concat(F.lit("obs_"), padded),
        "frequency": F.coalesce("frequency", infer_frequency("date")),
        "unit": F.coalesce("unit", F.lit(default_unit)),
        "method": F.coalesce("method", F.lit("direct")),
    })


def normalize(obs: DataFrame, dataset_unit: str | None = None, target_unit: str | None = None,
              dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalised, dropped): ISO date, canonical unit, optional conversion, resolved entity. Nothing is imputed."""
    obs = with_observation_columns(obs)
    dropped = obs.filter(parse_date("date").isNull()).select("ord", "date", F.lit("unparsable-date").alias("reason"))
    raw_unit = F.coalesce(F.col("unit"), F.lit(dataset_unit).cast("string"))
    # One evaluation of each rule: the generator drops unreadable dates, and fields are taken from stored structs.
    dated = obs.select("*", F.inline(F.array_compact(F.array(parse_date("date")))).alias("_iso", "_frequency", "_key"))
    dated = dated.withColumn("_unit", normalize_unit(raw_unit))
    value, factor = F.col("value"), F.lit(None).cast("double")
    if target_unit:
        dated = dated.withColumn("_converted", convert_known(value, F.col("_unit"), normalize_unit(F.lit(target_unit))))
        value, factor = F.coalesce("_converted", value), F.when(F.col("_converted").isNotNull(), F.col("_unit.factor"))
    rows = resolve_entities(dated, "entity", dictionary).select(
        "ord", F.col("resolved_name").alias("entity"), F.col("resolved_id").alias("entity_id"), "resolution", "iso2",
        F.col("date").alias("source_date"), F.col("_iso").alias("date"), F.col("_frequency").alias("frequency"),
        F.col("_key").alias("sort_key"), value.alias("value"),
        F.when(F.col("value").isNull(), F.lit("UNKNOWN")).otherwise(F.coalesce("status", F.lit("SUPPORTED"))).alias("status"),
        F.col("_unit.canonical").alias("unit"), F.col("_unit.dimension").alias("unit_dimension"), F.col("_unit.known").alias("unit_known"),
        factor.alias("conversion_factor"), "geography", "source", "source_url", "confidence")
    return rows, dropped


def distinct_entities(obs: DataFrame) -> DataFrame:
    return obs.groupBy("entity_id").agg(F.min_by("entity", "ord").alias("entity"))


def revise(obs: DataFrame, allow_statuses: list[str] | None = None, remove_entities: list[str] | None = None,
           annual_only: bool = False, top_n: int | None = None) -> DataFrame:
    """Apply a revision: statuses, entities, annual rows, then the top-N of each written date (nulls last)."""
    if allow_statuses:
        obs = obs.filter(F.col("status").isin(allow_statuses))
    if remove_entities:
        obs = obs.filter(~F.col("entity_id").isin(remove_entities))
    if annual_only:
        obs = obs.filter(F.col("frequency") == "annual")
    if top_n:
        order = [F.col("value").desc_nulls_last(), F.col("ord")]
        obs = first_per_group(obs, ["date"], order, top_n, "_n").drop("_n")
    return obs


def tape_input(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations a tape may use, one-row count of the excluded ones)."""
    out = F.coalesce(F.col("status").isin("CONFLICTING", "REJECTED"), F.lit(False))
    return obs.filter(~out), obs.filter(out).agg(F.count("*").alias("excluded"))


def browse(obs: DataFrame, limit: int, text: str = "") -> DataFrame:
    """Latest valued rows whose entity contains ``text``; the limit is the feature."""
    shown = obs.filter(F.col("value").isNotNull() & F.lower("entity").contains(text.lower()))
    return shown.orderBy(F.col("date").desc(), F.col("ord")).limit(limit)


def to_core(obs: DataFrame) -> DataFrame:
    """Nested observations to the flat working columns."""
    return obs.select(F.col("entity.name").alias("entity"), "date", "value", "unit", "frequency", "geography", "status",
                      F.col("source.publisher").alias("source"), F.col("source.url").alias("source_url"), "confidence")


def to_nested(obs: DataFrame) -> DataFrame:
    """Flat rows to the nested form written at a sink."""
    obs = with_observation_columns(obs)
    return obs.select(
        "observation_id", F.struct(F.col("entity_id").alias("id"), F.col("entity").alias("name")).alias("entity"), "date",
        "frequency", "value", "unit", "geography",
        F.struct(F.col("source_url").alias("url"), F.col("source").alias("publisher")).alias("source"), "method", "status", "confidence")
