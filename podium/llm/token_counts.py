"""Token counts of documents in flat, unindexed token files, by searching for their separators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Stages
from .bitpack import filesystem
from .common import TASKS, documents, slices
from .encoding import encoder

BLOCK_BYTES = 4 << 20
_SUPER = 1024  # blocks per first-level group of the prefix scan


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, stages: Stages, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Token files without any index, one per task: each document's ids, then ``end_id``.

    Returns (files: part, path, n_bytes, width) and (names: part, ordinal, doc_id). A special token's string inside a text is encoded as
    ordinary text, so that only ends of documents carry ``end_id``.
    """
    folder = stages.path("files")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_bytes", pa.int64()), ("width", pa.int32()),
                        ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, stream, ordinal, size = encoder(tokenizer, True), TaskContext.get().partitionId(), None, 0, 0
        for batch in slices(batches, byte_bound=2 << 20):
            if stream is None:
                files, path = filesystem(f"{folder}/part-{part:06d}.tokens")
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = files.open_output_stream(partial := f"{path}.{uuid.uuid4().hex}")
            ids, at = tool.column(batch["text"])
            ids = np.insert(ids, at[1:], end_id)
            stream.write(ids.tobytes())
            size += ids.nbytes
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                                              pa.array(range(ordinal, ordinal + n), pa.int64()), batch["doc_id"]], schema=schema)
            ordinal += n
        if stream is not None:
            stream.close()
            files.move(partial, path)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.tokens"], "n_bytes": [size], "width": [ids.itemsize],
                                              "ordinal": [None], "doc_id": [None]}, schema)

    said = stages.write(documents(docs, id_col, text_col).mapInArrow(
        write, "part int, path string, n_bytes bigint, width int, ordinal bigint, doc_id bigint"), "names")
    return said.filter("path IS NOT NULL").select("part", "path", "n_bytes", "width"), said.filter("path IS NULL").select("part", "ordinal", "doc_id")


def scan_flat(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(part, ordinal, n_tokens) of every document in flat token files; the separator itself is not counted.

    ``files``: part, path, n_bytes, width (bytes per id, 2 or 4). Every block is read on its own and reports the
    distances between its separators. What a block leaves open is added to the first separator that follows, however
    many blocks later, by a prefix scan in two levels: inside groups of blocks, then over the groups. Ids after a
    file's last separator are its last document.
    """
    blocks = files.filter("n_bytes > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bytes") - 1) / block_bytes))))
    blocks = blocks.withColumn("at", F.col("block") * block_bytes).withColumn("take", F.least(F.lit(block_bytes), F.col("n_bytes") - F.col("at")))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ends", pa.int64()), ("open", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = filesystem(row["path"])
                with store.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(row["take"], row["at"]), f"<u{row['width']}")
                hits = np.flatnonzero(ids == end_id)
                lengths = np.diff(hits, prepend=-1) - 1
                left = len(ids) - (hits[-1] + 1 if len(hits) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["block"]]), pa.array([len(hits)]),
                                                  pa.array([int(left)]), pa.array([lengths], pa.list_(pa.int64()))], schema=schema)

    # A number of its own, as the list of blocks is short and Spark would otherwise read them in one task.
    tasks = files.filter("n_bytes > 0").agg(F.sum(F.floor((F.col("n_bytes") - 1) / block_bytes) + 1)).first()[0] or 1
    found = blocks.select("part", "path", "width", "block", "at", "take").repartition(min(tasks, TASKS), "part", "block").mapInArrow(
        search, "part int, block bigint, ends bigint, open bigint, lengths array<bigint>")
    found = found.withColumn("group", F.floor(F.col("block") / _SUPER))

    def scanned(rows: DataFrame, keys: list[str], by: str, tag: str) -> DataFrame:
        """Add ends before a row and what is open there, within ``keys``."""
        earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_run", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
        same = Window.partitionBy(*keys, "_run").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        # Rows of one run: the first may follow a row with ends, whose open part it takes over.
        last = F.coalesce(F.lag("open").over(Window.partitionBy(*keys).orderBy(by)), F.lit(0))
        rows = rows.withColumn("_from", last)
        return rows.withColumn(f"{tag}_open", F.col("_from") + F.coalesce(F.sum("_from").over(same), F.lit(0))).withColumnRenamed("_run", f"{tag}_ends").drop("_from")

    inner = scanned(found, ["part", "group"], "block", "in")
    groups = inner.groupBy("part", "group").agg(
        F.sum("ends").alias("ends"),
        F.max_by(F.when(F.col("ends") > 0, F.col("open")).otherwise(F.col("in_open") + F.col("open")), "block").alias("open"))
    outer = scanned(groups, ["part"], "group", "out").select("part", "group", "out_ends", "out_open")
    # The planner takes both sides for as small as the list of files they come from, so it must not choose to broadcast.
    whole = inner.hint("merge").join(outer, ["part", "group"])
    carried = F.col("in_open") + F.when(F.col("in_ends") == 0, F.col("out_open")).otherwise(0)
    first = F.col("out_ends") + F.col("in_ends")
    whole = whole.select("part", "block", "ends", "lengths", "open", carried.alias("carried"), first.alias("first"))
    closed = whole.select("part", "first", "carried", F.posexplode("lengths").alias("i", "n")).select(
        "part", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    last = whole.groupBy("part").agg(F.max_by(F.struct(F.col("first") + F.col("ends"), F.when(F.col("ends") > 0, F.col("open")).otherwise(
        F.col("carried") + F.col("open"))), "block").alias("end"))
    return closed.unionByName(last.filter("end.col2 > 0").select("part", F.col("end.col1").alias("ordinal"), F.col("end.col2").alias("n_tokens")))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as flat token files and count each document's tokens from them: doc_id, n_tokens, part, ordinal.

    Null text is empty (0 tokens). Null and repeated ids are counted row by row. Texts of any length are counted whole. An empty
    table gives no rows. Other columns are ignored.
    """
    files, names = write_flat(docs, tokenizer, end_id, Stages(docs.sparkSession, "token-counts"), id_col, text_col)
    return names.hint("merge").join(scan_flat(files, end_id), ["part", "ordinal"]).select("doc_id", "n_tokens", "part", "ordinal")
