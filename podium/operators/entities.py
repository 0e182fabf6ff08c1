"""Entity resolution against a dictionary of countries (or any table of the same shape)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..country_values import COUNTRIES
from ..functions import alias_name, has_real_flag, norm_key, slugify


SHAPE = "name string, iso2 string, iso3 string, region string, aliases array<string>"


def country_dictionary(spark: SparkSession) -> DataFrame:
    """The default dictionary: name, iso2, iso3, region, aliases."""
    rows = [{"name": n, "iso2": a, "iso3": b, "region": r, "aliases": [s.strip() for s in more.split(";") if s.strip()]}
            for n, a, b, r, more in fixed.table(COUNTRIES)]
    struct = ", ".join(f.replace(" ", ": ", 1) for f in SHAPE.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{struct}>>")))


def dictionary_keys(dictionary: DataFrame) -> DataFrame:
    """One row per comparison key: the single entry it names, or the names it could mean."""
    spellings = F.concat(F.array("name", "iso2", "iso3"), F.coalesce("aliases", F.array().cast("array<string>")))
    spelled = dictionary.select(F.explode(spellings).alias("spelling"), F.struct("name", "iso2", "region").alias("entry"))
    keyed = spelled.groupBy(norm_key("spelling").alias("key")).agg(F.array_sort(F.collect_set("entry")).alias("entries")).filter("key != ''")
    first = F.col("entries")[0]
    return keyed.select("key", F.size("entries").alias("hits"), first["name"].alias("known_name"), first["iso2"].alias("iso2"),
                        first["region"].alias("region"), F.transform("entries", lambda e: e["name"]).alias("names"))


def resolve_entities(df: DataFrame, column: str = "entity", dictionary: DataFrame | None = None) -> DataFrame:
    """Add resolution (resolved, ambiguous, unresolved), resolved_id, resolved_name, iso2, flag_code, region, candidates.

    The default dictionary has a fixed size (429 spellings) and is broadcast. A dictionary passed in may be of any
    size, so the planner chooses its join.
    """
    if dictionary is None:
        keys = F.broadcast(dictionary_keys(country_dictionary(df.sparkSession)))
    else:
        keys = dictionary_keys(dictionary)
    joined = df.withColumn("key", norm_key(column)).join(keys, "key", "left")
    one, many = F.col("hits") == 1, F.col("hits") > 1
    status = F.when(one, F.lit("resolved")).when(many, F.lit("ambiguous")).otherwise(F.lit("unresolved"))
    iso2 = F.when(one, F.col("iso2"))
    return joined.withColumns({
        "resolution": status,
        "resolved_id": F.when(F.col("key") == "", F.lit("")).otherwise(slugify(F.when(one, F.col("known_name")).otherwise(F.col(column)))),
        "resolved_name": F.when(one, F.col("known_name")).otherwise(F.col(column)),
        "iso2": iso2,
        "flag_code": F.when(one & has_real_flag("iso2"), F.lower(iso2)),
        "region": F.when(one, F.col("region")),
        "candidates": F.when(many, F.col("names")),
    }).drop("key", "hits", "known_name", "names")


def countries_only(df: DataFrame, column: str = "entity", dictionary: DataFrame | None = None) -> DataFrame:
    """Rows that resolve to a country with a flag of its own, named as in the dictionary."""
    found = resolve_entities(df, column, dictionary).filter((F.col("resolution") == "resolved") & F.col("flag_code").isNotNull())
    return found.withColumn(column, F.col("resolved_name")).select(*df.columns)


def canonical_names(df: DataFrame, column: str = "entity", dictionary: DataFrame | None = None) -> DataFrame:
    """Dictionary name where the entity resolves, else the alias table's name."""
    found = resolve_entities(df, column, dictionary)
    name = F.when(F.col("resolution") == "resolved", F.col("resolved_name")).otherwise(alias_name(column))
    return found.withColumn(column, name).select(*df.columns)


def keep_entities(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose entity name or id is listed, case-insensitively."""
    wanted = [n.lower() for n in names]
    return df.filter(F.lower("entity").isin(wanted) | F.col("entity_id").isin(wanted))
