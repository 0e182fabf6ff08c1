"""JSON of any shape as VARIANT: one scan, no pass that infers a schema, and no schema that all documents must share.

``read_json_table`` asks Spark for one schema of all files. Here a document stays a VARIANT until a field is asked for, so that
envelopes, nested values and fields that are text in one document and an object in the next may be mixed at will.
Numbers come in their shortest form (``1.50`` as ``1.5``), keys of nested objects in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fixed
from ..functions import clean
from .readers import SOURCE_FILE


def read_variants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents as (source_file, doc): one per file, or one per line with ``lines``. Blank ones are skipped.

    Text that is no JSON has a null ``doc``; ``document_kinds`` counts it. A file is read whole by one task, so
    large inputs belong into lines.
    """
    raw = spark.read.text(path, wholetext=not lines).filter(F.length(clean("value")) > 0)
    return raw.select(F.col("_metadata.file_name").alias(SOURCE_FILE), F.try_parse_json("value").alias("doc"))


def _path(*keys: str) -> str:
    """Path of a field by its exact name, whatever letters the name holds."""
    out = "$"
    for key in keys:
        if "'" in key and '"' in key:
            raise ValueError(f"no path can name the field {key}")
        out += f'["{key}"]' if "'" in key else f"['{key}']"
    return out


def variant_text(record: Column | str, *keys: str) -> Column:
    """A field as text: null where it is missing or null, nested values as their JSON."""
    return F.try_variant_get(record, _path(*keys), "string")


def _is_object(value: Column | str) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _lists(doc: str, envelopes: tuple[str, ...]) -> dict[str, Column]:
    """Where a document may hold its records, first come first served."""
    return {"list": F.try_variant_get(doc, "$", "array<variant>")} | {
        name: F.try_variant_get(doc, _path(name), "array<variant>") for name in envelopes}


def document_kinds(docs: DataFrame, envelopes: tuple[str, ...] = fixed.JSON_ENVELOPES) -> DataFrame:
    """Documents per kind: ``list``, the name of the envelope, ``object``, ``scalar``, or ``unreadable``; and their records."""
    lists = _lists("doc", envelopes)
    kind = F.coalesce(*[F.when(items.isNotNull(), F.lit(name)) for name, items in lists.items()], F.when(_is_object("doc"), F.lit("object")),
                      F.when(F.col("doc").isNotNull(), F.lit("scalar")), F.lit("unreadable"))
    held = F.coalesce(*[F.size(F.filter(items, _is_object)) for items in lists.values()], F.when(_is_object("doc"), F.lit(1)), F.lit(0))
    return docs.select(kind.alias("kind"), held.alias("held")).groupBy("kind").agg(F.count("*").alias("documents"), F.sum("held").alias("records"))


def variant_records(docs: DataFrame, envelopes: tuple[str, ...] = fixed.JSON_ENVELOPES) -> DataFrame:
    """One row (the other columns, place, record) per object of each document.

    The objects are those of a list, else of the first present envelope list, else the document itself. Members of a list that
    are no objects, scalars and unreadable documents have no records.
    """
    rest = [c for c in docs.columns if c != "doc"]
    items = F.coalesce(*_lists("doc", envelopes).values(), F.when(_is_object("doc"), F.array("doc")))
    return docs.select(*rest, F.posexplode(items).alias("place", "record")).filter(_is_object("record"))


def variant_table(records: DataFrame, columns: list[str]) -> DataFrame:
    """The named fields of each record as text, empty where they are missing or null, as the other readers give them."""
    return records.select(*[F.coalesce(variant_text("record", c), F.lit("")).alias(c) for c in columns])


def variant_cells(records: DataFrame) -> DataFrame:
    """Long form for records whose fields nobody knows beforehand: the other columns, key and value, nulls included."""
    rest = [c for c in records.columns if c != "record"]
    return records.select(*rest, F.explode(F.try_variant_get("record", "$", "map<string,variant>")).alias("key", "value"))


def variant_columns(records: DataFrame) -> DataFrame:
    """Every field that occurs: key, rows that hold it, and the narrowest type that all its values have."""
    return variant_cells(records).groupBy("key").agg(F.count("*").alias("rows"), F.schema_of_variant_agg("value").alias("type"))


def _text_or(field: str, *inside: str) -> Column:
    """A field that is plain text, or an object whose first present member is used."""
    whole = F.try_variant_get("record", _path(field), "variant")
    return F.when(_is_object(whole), F.coalesce(*[variant_text("record", field, name) for name in inside])).otherwise(variant_text("record", field))


def _number(field: str) -> Column:
    """A field written as a number; text that looks like one is no number."""
    kind = F.schema_of_variant(F.try_variant_get("record", _path(field), "variant"))
    return F.when(~kind.isin("STRING", "BOOLEAN"), F.try_variant_get("record", _path(field), "double"))


def variant_observations(records: DataFrame) -> DataFrame:
    """Observation records as flat working rows, like ``read_observations`` for documents in any envelope.

    ``ord`` depends on task placement: write the rows before using it twice.
    """
    plain = [variant_text("record", name).alias(name) for name in ("unit", "frequency", "geography", "status")]
    return records.select(
        F.monotonically_increasing_id().alias("ord"), F.coalesce(_text_or("entity", "name", "id"), F.lit("")).alias("entity"),
        variant_text("record", "date").alias("date"), _number("value").alias("value"), *plain,
        _text_or("source", "publisher", "title", "url").alias("source"),
        F.coalesce(variant_text("record", "sourceUrl"), variant_text("record", "source", "url")).alias("source_url"), _number("confidence").alias("confidence"))
