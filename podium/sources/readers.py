"""Readers. A table read here is all strings (or null), plus the file it came from: nothing is interpreted yet."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fixed
from ..functions import clean

SOURCE_FILE = "source_file"
#: No JSON text holds these control characters as they are, so each document is one "line".
#: With ``multiLine`` every file would carry the list of all files while names are inferred, and every number read as text
#: would be a read of its own from the file.
WHOLE_DOCUMENT = dict(lineSep="\x01\x02\x03\x04\x05\x06\x07\x08")


def _file_name() -> Column:
    return F.regexp_extract("_metadata.file_name", r"([^/]*)$", 1).alias(SOURCE_FILE)


def _not_blank(columns: list[str]) -> Column:
    return F.length(clean(F.concat_ws("", *[F.col(f"`{c}`") for c in columns]))) > 0


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, ragged: str | None = None) -> DataFrame:
    """Delimited text with a header. Cells are trimmed, blank rows dropped, short rows padded.

    Several files must have the same header: one in another order or with other names is an error, never read by
    position. Cells beyond the header have no column; name a column ``ragged`` to get the whole line of every row whose
    number of cells is not the header's. ``multi_line`` allows line breaks inside quotes; such a file cannot be split,
    so leave it off for big files without them.
    """
    options = dict(header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE", multiLine=multi_line, ignoreLeadingWhiteSpace=True,
                   ignoreTrailingWhiteSpace=True, enforceSchema=False)
    raw = spark.read.csv(path, inferSchema=False, **options)
    heads = raw.columns
    if ragged is not None:
        raw = spark.read.schema(_text_columns([*heads, ragged])).csv(path, columnNameOfCorruptRecord=ragged, **options)
    names = [c.strip() for c in heads]
    cells = [clean(F.col(f"`{c}`")).alias(n) for c, n in zip(heads, names)]
    return raw.select(*cells, *([ragged] if ragged else []), _file_name()).filter(_not_blank(names))


def _text_columns(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _no_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_json_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """JSON documents, one per file: a list of objects, an object holding such a list, or one object.

    In each document the list is the first present of the known envelope names; a document without any is a row itself.
    The first pass finds the names only (give ``columns`` to spare it); the second asks for text, so numbers and nested
    values come as they are written and null as empty text.
    """
    lists = dict.fromkeys(fixed.JSON_ENVELOPES, columns)
    if columns is None:
        found = spark.read.json(path, primitivesAsString=True, **WHOLE_DOCUMENT).schema
        kinds = {f.name: f.dataType.elementType for f in found.fields
                 if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
        lists = {name: kinds[name].names for name in fixed.JSON_ENVELOPES if name in kinds}
        columns = list(dict.fromkeys(c for names in lists.values() for c in names)) or found.names
    row = _text_columns(columns)
    own = [c for c in columns if c not in lists]
    fields = [*row.fields, *[T.StructField(name, T.ArrayType(row)) for name in lists]]
    docs = spark.read.schema(T.StructType([f for f in fields if f.name in own or f.name in lists])).json(path, **WHOLE_DOCUMENT)
    plain = F.struct(*[(F.col(f"`{c}`") if c in own else F.lit(None).cast("string")).alias(c) for c in columns])
    rows = [F.col(f"`{name}`") for name in lists]
    if own:
        rows.append(F.when(F.size(F.array_compact(F.array(*[F.col(f"`{c}`") for c in own]))) > 0, F.array(plain)))
    return _no_nulls(docs.select(F.inline(F.coalesce(*rows))))


def read_jsonl(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One object per line; blank lines are skipped and a bad line is an error.

    Give ``columns`` to spare the pass that finds the names.
    """
    if columns is None:
        columns = spark.read.json(path, mode="FAILFAST", primitivesAsString=True).columns
    return _no_nulls(spark.read.schema(_text_columns(columns)).json(path, mode="FAILFAST"))


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read by extension (or ``kind`` where a folder has none)."""
    ext = (kind or path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]).lower()
    if ext in ("csv", "txt"):
        return read_delimited(spark, path)
    if ext in ("tsv", "tab"):
        return read_delimited(spark, path, sep="\t")
    if ext == "json":
        return read_json_table(spark, path)
    if ext in ("jsonl", "ndjson"):
        return read_jsonl(spark, path)
    if ext == "zip":
        return read_zipped(spark, path)
    if ext == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported input extension: .{ext}")


def upload_kind(name: Column | str) -> Column:
    """Kind of an uploaded file by its name."""
    lower = F.lower(F.col(name) if isinstance(name, str) else name)
    return (F.when(lower.rlike(r"\.(csv|tsv)$"), F.lit("csv")).when(lower.rlike(r"\.(xlsx|xls|ods)$"), F.lit("xlsx"))
            .when(lower.rlike(r"\.jsonl?$"), F.lit("json")).when(lower.rlike(r"\.pdf$"), F.lit("pdf"))
            .when(lower.rlike(r"\.(png|jpe?g|webp|gif)$"), F.lit("image")).when(lower.rlike(r"\.txt$"), F.lit("txt"))
            .otherwise(F.lit("unknown")))


def _member_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the first delimited member of each archive, streamed in slices."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            if not bytes(content[:4]) == b"PK\x03\x04":
                raise ValueError(f"{path} is not a zip archive")
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                member = next((m for m in archive.namelist() if m.lower().endswith((".csv", ".tsv", ".txt"))), None)
                if member is None:
                    raise ValueError(f"{path} is a zip archive without a delimited file")
                with archive.open(member) as stream:
                    text = io.TextIOWrapper(stream, "utf-8", newline="")
                    rows = csv.reader(text, delimiter="\t" if member.lower().endswith(".tsv") else ",")
                    header, held, at = next(rows, []), [], 0
                    for row in rows:
                        if any(cell.strip() for cell in row):
                            held.append((path, member, at, [h.strip() for h in header], [c.strip() for c in row]))
                            at += 1
                        if len(held) == 5000:
                            yield pd.DataFrame(held, columns=["path", "member", "row", "header", "cells"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["path", "member", "row", "header", "cells"])


def read_zipped_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, member, row, header, cells) of the first delimited member of each archive under ``path``.

    Archives spread over the tasks; inside a task a member is streamed, never held as a whole table.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_member_rows, "path string, member string, row bigint, header array<string>, cells array<string>")


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """Archives as one table with the columns of all their headers; cells go by name, not by place."""
    rows = read_zipped_cells(spark, path)
    headers = [r["header"] for r in rows.filter("row = 0").select("path", "header").distinct().orderBy("path").collect()]  # one per archive
    if not headers:
        raise ValueError(f"no rows in the archives at {path}")
    names = list(dict.fromkeys(name for header in headers for name in header))
    cells = [F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1).alias(name) for name in names]
    return rows.select(*cells, F.regexp_extract("path", r"([^/]*)$", 1).alias(SOURCE_FILE))


def _text_or(field: str, *paths: str) -> Column:
    """A field that is plain text, or an object whose first present path is used."""
    raw = F.col(field)
    inside = [F.get_json_object(raw, f"$.{p}") for p in paths]
    return F.when(F.ltrim(raw).startswith("{"), F.coalesce(*inside)).otherwise(raw)


OBSERVATION_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("entity", T.StringType()), ("date", T.StringType()), ("value", T.DoubleType()), ("unit", T.StringType()),
    ("frequency", T.StringType()), ("geography", T.StringType()), ("status", T.StringType()), ("source", T.StringType()),
    ("sourceUrl", T.StringType()), ("confidence", T.DoubleType()))])


def read_observations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Observation records whose entity and source are text or objects, as flat working rows.

    The schema is given, so no inference pass runs; Spark hands objects over as their JSON text.
    """
    raw = spark.read.schema(OBSERVATION_SCHEMA).json(path, multiLine=multi_line)
    url = F.when(F.ltrim("source").startswith("{"), F.get_json_object("source", "$.url"))
    return raw.select(
        F.monotonically_increasing_id().alias("ord"), F.coalesce(_text_or("entity", "name", "id"), F.lit("")).alias("entity"),
        "date", "value", "unit", "frequency", "geography", "status", _text_or("source", "publisher", "title", "url").alias("source"),
        F.coalesce("sourceUrl", url).alias("source_url"), "confidence")
