"""Token ids in files of fixed-width bit fields, with block offsets for random access.

A file holds documents in ascending id order. Layout, little-endian:

    blocks      each block's ids as consecutive bit fields, lowest bit first, filled up to whole bytes
    offsets     start of each block in the file (uint64), then its CRC-32 (uint32)
    documents   id (int64), absent flag (uint8) and length (uint64) of each document
    footer      magic, bits per id, ids per block, ids, documents, start of the block offsets

Unpacking and packing are array operations over groups of eight ids, which fill a whole number of bytes at any width.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Stages
from .common import TASKS, documents, slices
from .encoding import encoder

_MAGIC = b"PODBITS1"
_FOOTER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as bit fields of ``bits`` bits (at most 32)."""
    groups = np.zeros((len(ids) + 7) // 8 * 8, np.uint64)
    groups[: len(ids)] = ids
    groups = groups.reshape(-1, 8)
    out = np.zeros((len(groups), bits + 8), np.uint8)
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        field = groups[:, lane] << np.uint64(shift)
        for byte in range((bits + shift + 7) // 8):
            out[:, at + byte] |= ((field >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``, as uint32."""
    raw = np.zeros((count + 7) // 8 * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)[: len(raw)]
    raw = raw.reshape(-1, bits)
    out = np.empty((len(raw), 8), np.uint32)
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        field = np.zeros(len(raw), np.uint64)
        for byte in range((bits + shift + 7) // 8):
            field |= raw[:, at + byte].astype(np.uint64) << np.uint64(8 * byte)
        out[:, lane] = (field >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; only one block is held. The file appears under its name when it is whole."""

    def __init__(self, path: str, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.fs, self.path = filesystem(path)
        self.part, self.bits, self.block_ids = f"{self.path}.{uuid.uuid4().hex}", bits, block_ids
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.data, self.held, self.n_held = self.fs.open_output_stream(self.part), [], 0
        self.offsets, self.sums, self.ids, self.lengths, self.at = [], [], [], [], 0

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sums.append(zlib.crc32(packed))
        self.data.write(packed)
        self.at += len(packed)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append documents: their ids one after another, and how many each has."""
        self.ids += doc_ids
        self.lengths += lengths.tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        total = sum(self.lengths)
        tail = np.array(self.offsets, "<u8").tobytes() + np.array(self.sums, "<u4").tobytes()
        tail += np.array([0 if x is None else x for x in self.ids], "<i8").tobytes()
        tail += np.array([x is None for x in self.ids], "u1").tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.data.write(tail + _FOOTER.pack(_MAGIC, self.bits, self.block_ids, total, len(self.ids), self.at))
        self.data.close()
        self.fs.move(self.part, self.path)
        return len(self.ids), total


class Reader:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        fs, name = filesystem(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        magic, self.bits, self.block_ids, self.n_ids, self.n_docs, end = _FOOTER.unpack(
            self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        tail = self.file.read_at(size - _FOOTER.size - end, end)
        blocks = -(-self.n_ids // self.block_ids)
        parts = np.cumsum([0, 8 * blocks, 4 * blocks, 8 * self.n_docs, self.n_docs, 8 * self.n_docs])
        kinds = ("<u8", "<u4", "<i8", "u1", "<u8")
        self.offsets, self.sums, self.ids, self.absent, self.lengths = (
            np.frombuffer(tail[a:b], k) for a, b, k in zip(parts, parts[1:], kinds))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths.astype(np.int64))])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` to ``last``, both included."""
        out = []
        for b in range(first, last + 1):
            count = min(self.block_ids, self.n_ids - b * self.block_ids)
            data = self.file.read_at((count * self.bits + 7) // 8, int(self.offsets[b]))
            if zlib.crc32(data) != self.sums[b]:
                raise ValueError(f"block {b} is damaged")
            out.append(unpack(data, count, self.bits))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def read(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from position ``start`` on; reads only the blocks that hold them."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        return self.blocks(first, (start + length - 1) // self.block_ids)[start - first * self.block_ids :][:length]

    def document(self, n: int) -> np.ndarray:
        return self.read(int(self.starts[n]), int(self.lengths[n]))


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, stages: Stages, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode, pack and write ``docs`` in ascending id order; returns the manifest (part, path, n_docs, n_ids).

    Ranges of ids go to tasks, each of which writes one file. Rows of one id are ordered by where they stand in the
    input, so a repeated id spreads over several files, too. A repeated attempt writes the same file again.
    """
    folder = stages.path("files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, out = encoder(tokenizer), TaskContext.get().partitionId(), None
        path = f"{folder}/part-{part:06d}.bits"
        for batch in slices(batches, byte_bound=2 << 20):
            out = out or Writer(path, bits_for(tool.vocabulary))
            ids, at = tool.column(batch["text"])
            out.add(batch["doc_id"].to_pylist(), np.insert(ids, at[1:], end_id), np.diff(at) + 1)
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]},
                                             pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = ["doc_id", "_row"]
    laid = documents(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    return stages.write(laid.mapInArrow(write, "part int, path string, n_docs bigint, n_ids bigint"), "manifest")


def read_packed(manifest: DataFrame, span_blocks: int = 16) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document. ``start`` counts over all files.

    The window runs over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                file = Reader(path)
                sums, span = np.zeros(file.n_docs, np.int64), file.block_ids * span_blocks
                for at in range(0, file.n_ids, span):
                    ids = file.read(at, min(span, file.n_ids - at)).astype("<u4")
                    n = int(np.searchsorted(file.starts, at, "right")) - 1
                    while n < file.n_docs and file.starts[n] < at + len(ids):
                        a, b = max(file.starts[n] - at, 0), min(file.starts[n + 1] - at, len(ids))
                        sums[n] = zlib.crc32(ids[a:b], int(sums[n]))
                        n += 1
                ids = pa.array(file.ids, mask=file.absent.astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(file.starts[:-1] + base), pa.array(file.lengths.astype(np.int64)), pa.array(sums)], schema=schema)

    # A number of its own, as the manifest is a few rows that Spark would otherwise read in one task.
    return files.repartition(max(1, min(manifest.count(), TASKS)), "part").mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write packed files and read them back: doc_id, start, n_tokens, ids_crc32.

    Null text is empty (the end id alone). Null ids come first; rows of one id follow each other. An empty table gives
    no files and no rows. Other columns are ignored. Long texts are packed block by block.
    """
    return read_packed(write_packed(docs, tokenizer, end_id, Stages(docs.sparkSession, "bitpack"), id_col, text_col))
