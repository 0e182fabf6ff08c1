"""Sinks. Each artefact is a directory of part files; nothing is merged on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import to_nested


def write_dataset_csv(obs: DataFrame, path: str) -> None:
    """date, entity_id, entity_name, value in (date, entity_id) order; the order spans the part files."""
    rows = obs.select(F.coalesce("date", F.lit("")).alias("date"), F.coalesce("entity_id", F.lit("")).alias("entity_id"),
                      F.col("entity").alias("entity_name"), "value")
    rows.orderBy("date", "entity_id").write.mode("overwrite").csv(path, header=True)


def write_artefacts(folder: str, formats: dict[str, str] | None = None, **tables: DataFrame) -> dict[str, str]:
    """One directory per named table, Parquet unless ``formats`` says otherwise. Returns the paths."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").format((formats or {}).get(name, "parquet")).save(out[name])
    return out


def write_nested_json(obs: DataFrame, path: str) -> None:
    to_nested(obs).write.mode("overwrite").json(path, ignoreNullFields=False)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log lines; a damaged line is skipped."""
    lines = spark.read.schema(schema + ", _damaged string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_damaged")
    return lines.filter("_damaged is null").drop("_damaged")
