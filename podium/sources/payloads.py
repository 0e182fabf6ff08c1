"""Landed payloads of data services, read as tables. Fetching them is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clean, host_of, prefixed_slug
from .readers import read_delimited

INDICATOR_ROW = ("array<struct<country: struct<id: string, value: string>, indicator: struct<id: string, value: string>, "
                 "date: string, value: double>>")


def read_indicator_pages(spark: SparkSession, path: str, drop_codes: tuple[str, ...] = ("WLD",)) -> DataFrame:
    """Pages ``[meta, rows]``: one row per country, indicator and year that has a value."""
    pages = spark.read.text(path, wholetext=True)
    rows = pages.select(F.inline(F.from_json(F.get_json_object("value", "$[1]"), INDICATOR_ROW)))
    flat = rows.select(F.col("country.id").alias("country_code"), F.col("country.value").alias("entity"),
                       F.col("indicator.id").alias("indicator"), "date", "value")
    return flat.filter(F.col("value").isNotNull() & ~F.coalesce(F.col("country_code").isin(*drop_codes), F.lit(False)))


def sidecar_unit(metadata: Column | str) -> Column:
    """Unit named by a chart's metadata text: display unit of the first dimension, its unit, the chart's unit."""
    paths = ("$.dimensions[0].display.unit", "$.columns[0].display.unit", "$.dimensions[0].unit", "$.columns[0].unit", "$.unit")
    return F.coalesce(*[F.nullif(clean(F.get_json_object(metadata, p)), F.lit("")) for p in paths])


def read_charts(spark: SparkSession, csv_path: str, metadata_path: str) -> DataFrame:
    """Chart tables with the unit of their metadata sidecar, matched by file name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.metadata)?\.[a-z]+$", 1)
    units = spark.read.text(metadata_path, wholetext=True).select(name.alias("slug"), sidecar_unit("value").alias("unit"))
    table = read_delimited(spark, csv_path).withColumn("slug", F.regexp_extract("source_file", r"^(.*)\.[a-z]+$", 1))
    return table.join(units, "slug", "left").withColumn("unit", F.coalesce("unit", F.lit("count")))


PACKAGES = ("array<struct<title: string, name: string, license_title: string, "
            "resources: array<struct<name: string, url: string, format: string, last_modified: string>>>>")


def catalogue_resources(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Catalogue search payloads to one row per resource."""
    packages = payloads.select(F.inline(F.from_json(F.get_json_object(column, "$.result.results"), PACKAGES)))
    rows = packages.select(F.coalesce("title", "name").alias("dataset_title"), F.col("name").alias("dataset"),
                           F.col("license_title").alias("license"), F.posexplode("resources").alias("place", "r"))
    return rows.select("dataset_title", "dataset", "license", "place", F.coalesce("r.name", F.lit("resource")).alias("name"),
                       F.coalesce("r.url", F.lit("")).alias("url"), F.upper(F.coalesce("r.format", F.lit(""))).alias("format"),
                       F.col("r.last_modified").alias("last_modified"))


def resource_candidates(resources: DataFrame, source: str) -> DataFrame:
    """Resources with a web address as candidate sources with their quality dimensions."""
    table = F.col("format").isin("CSV", "JSON")
    web = resources.filter(F.col("url").startswith("http"))
    return web.select(
        prefixed_slug("ckan", F.concat_ws("-", "dataset", "name")).alias("candidate_id"), F.lit(source).alias("source"),
        F.coalesce(F.nullif(host_of("url"), F.lit("")), F.lit(source)).alias("publisher"), "url",
        F.when(table, F.lit("download")).otherwise(F.lit("web")).alias("access"),
        F.concat_ws(" - ", "dataset_title", "name").alias("title"), F.coalesce("license", F.lit("UNKNOWN")).alias("license"),
        F.col("format").isin("CSV", "JSON", "XLSX").alias("machine_readable"), F.lit(0.75).alias("authority"),
        F.lit(0.7).alias("directness"), F.lit(0.6).alias("coverage"), F.lit(0.5).alias("methodology"),
        F.lit(0.5).alias("recency"), F.lit(0.6).alias("consistency"))


def preferred_resource(resources: Column | str, pattern: str = "(?i)csv|json|xlsx?") -> Column:
    """First resource whose format matches, else the first one. Works on an array of structs with ``format``."""
    found = F.filter(resources, lambda r: F.coalesce(r["format"].rlike(pattern), F.lit(False)))
    return F.coalesce(F.get(found, F.lit(0)), F.get(resources, F.lit(0)))


COMMUNITY = ("array<struct<ref: string, title: string, subtitle: string, description: string, lastUpdated: string, "
             "licenseName: string>>")


def community_candidates(payloads: DataFrame, as_of: str, column: str = "value") -> DataFrame:
    """Dataset-list payloads of a community catalogue as candidates; a year without update lowers recency."""
    sets = payloads.select(F.inline(F.from_json(F.col(column), COMMUNITY)))
    updated = F.try_to_timestamp(F.substring("lastUpdated", 1, 10), F.lit("yyyy-MM-dd"))
    fresh = F.coalesce(F.datediff(F.to_date(F.lit(as_of)), updated) < 365, F.lit(False))
    return sets.select(
        prefixed_slug("kaggle", "ref").alias("candidate_id"), F.substring_index("ref", "/", 1).alias("owner"), "ref",
        F.coalesce("title", "ref").alias("title"), F.coalesce("subtitle", F.col("description")).alias("description"),
        F.coalesce("licenseName", F.lit("UNKNOWN")).alias("license"), F.lit(True).alias("machine_readable"),
        F.lit(0.55).alias("authority"), F.lit(0.5).alias("directness"), F.lit(0.6).alias("coverage"),
        F.lit(0.4).alias("methodology"), F.when(fresh, F.lit(0.7)).otherwise(F.lit(0.4)).alias("recency"), F.lit(0.4).alias("consistency"))


def row_service_table(payloads: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """Row-service payloads ``{features, rows: [{row}]}`` as text columns."""
    rows = payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.rows"), "array<struct<row: string>>")).alias("r"))
    return rows.select(*[F.coalesce(F.get_json_object("r.row", f"$['{c}']"), F.lit("")).alias(c) for c in columns])
