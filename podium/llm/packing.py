"""Packing of documents into fixed windows, each filled with lexical neighbours of the document that opens it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import Stages
from .common import documents, slices
from .encoding import encoder

_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_SEQUENCES = 40  # a sequence id is the task's number, then the sequence's number in that many bits


class Shard:
    """BM25 inverted index over one block of unpacked remainders, each with the term counts of its whole document; terms are token ids."""

    def __init__(self, units: list[tuple[np.ndarray, tuple]], idf: np.ndarray, mean_length: float, k1: float, b: float) -> None:
        self.units = units
        texts = [known[3:] for _, known in units]
        lengths = np.array([n.sum() for _, n in texts], np.int64)
        terms = np.concatenate([t for t, _ in texts]).astype(np.int64)
        owner = np.repeat(np.arange(len(units)), [len(t) for t, _ in texts])
        order = np.lexsort((owner, terms))
        self.term, self.unit, tf = terms[order], owner[order], np.concatenate([n for _, n in texts])[order].astype(np.int64)
        norm = k1 * (1 - b + b * lengths / max(mean_length, 1.0))
        self.weight = idf[self.term] * tf * (k1 + 1) / (tf + norm[self.unit])
        self.names, self.begin = np.unique(self.term, return_index=True)
        self.begin, self.gone = np.append(self.begin, len(self.term)), 0
        # All terms of each unit, as places in ``names``: what it asks for when it opens a window.
        self.queries = [np.searchsorted(self.names, t) for t, _ in texts]

    def scores(self, n: int) -> np.ndarray:
        """BM25 score of each unit for all terms of the seed."""
        spans = [slice(i, j) for i, j in zip(self.begin[self.queries[n]].tolist(), self.begin[self.queries[n] + 1].tolist()) if i < j]
        if not spans:
            return np.zeros(len(self.units))
        return np.bincount(np.concatenate([self.unit[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.units))

    def neighbours(self, n: int) -> np.ndarray:
        """Units that share a term with the seed, best first; ties go to the earlier unit."""
        scores = self.scores(n)
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]

    def following(self, n: int, used: np.ndarray) -> Iterator[int]:
        """The neighbours that are not ``used`` yet, in the same order. Few are taken, so they are not sorted."""
        self._without(used)
        scores = self.scores(n)
        scores[used] = 0
        while scores[best := int(np.argmax(scores))] > 0:
            scores[best] = 0
            yield best

    def _without(self, used: np.ndarray) -> None:
        """Used units leave the postings when they are an eighth of those in them."""
        gone = int(used.sum())
        if 8 * (gone - self.gone) < len(used) - self.gone:
            return
        keep, self.gone = ~used[self.unit], gone
        self.begin = np.concatenate([[0], np.cumsum(keep)])[self.begin]
        self.unit, self.weight = self.unit[keep], self.weight[keep]


def fill(shard: Shard, window: int, last: bool) -> Iterator[list[tuple[np.ndarray, tuple]]]:
    """Windows as lists of (ids, what is known of the piece). Units that do not fill a window at the end are yielded only if ``last``.

    The seed is the first unused unit, or what is left of the one that was cut last. Its neighbours follow by score until the window
    is full; the last is cut and its rest opens the next window. When no neighbour is left, the next unused unit follows.
    """
    units, used, at = shard.units, np.zeros(len(shard.units), bool), 0
    rest: tuple[int, np.ndarray, tuple] | None = None
    while True:
        if rest is None:
            while at < len(units) and used[at]:
                at += 1
            if at == len(units):
                return
            used[at] = True
            rest = (at, *units[at])
        seed, pieces, free = rest[0], [], window
        found: Iterator[int] = iter([])
        asked = False
        while True:
            n, ids, known = rest
            take = min(free, len(ids))
            pieces.append((ids[:take], known))
            free -= take
            rest = (n, ids[take:], (known[0], known[1] + take, *known[2:])) if take < len(ids) else None
            if not free or rest:
                break
            if not asked:
                found, asked = shard.following(seed, used), True
            following = next((i for i in found if not used[i]), None)
            if following is None:
                while at < len(units) and used[at]:
                    at += 1
                following = at if at < len(units) else None
            if following is None:
                break
            used[following] = True
            rest = (following, *units[following])
        if free and not last:
            yield [*pieces, (np.zeros(0, np.uint32), ("open",))]
        else:
            yield pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, shard_docs: int = 2048, k1: float = 1.2, b: float = 0.75,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's whole windows are sequences of their own. Documents are shuffled by their term of the highest weight that another
    one has, too (those of a frequent term to several tasks), and sorted by it. A remainder is a unit of a shard: a block of
    ``shard_docs`` consecutive documents of a task, with its own inverted index. Its terms are those of its whole document, and document
    frequencies and lengths those of all whole documents. What does not fill a window goes on to the task's next shard, so a task leaves one short sequence.

    Null text is empty: one piece, the end id. Null and repeated ids are packed row by row. Ties go to the earlier row as sorted. Texts of
    any length are packed whole. An empty table gives no rows. Other columns are ignored. Shards are bounded however rows are distributed; a seed asks no
    shard but its own.
    """
    stages = Stages(docs.sparkSession, "packing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in slices(batches, 512, 2 << 20):
            ids, at = tool.column(batch["text"])
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            sums, rests, terms, counts = [], [], [], []
            # The distinct ids of all texts of the slice at once, each with its text's number.
            both, many = np.unique(np.repeat(np.arange(batch.num_rows) << 32, np.diff(at)) | ids, return_counts=True)
            term, many = (both & 0xFFFFFFFF).astype(ids.dtype), many.astype("<u4")
            cut = np.searchsorted(both, np.arange(batch.num_rows + 1) << 32).tolist()
            for i, j, c, d in zip(at.tolist(), at[1:].tolist(), cut, cut[1:]):
                whole = (j - i) // window * window
                sums.append([zlib.crc32(ids[k : k + window].astype("<u4")) for k in range(i, i + whole, window)])
                rests.append(ids[i + whole : j].tobytes())
                terms.append(term[c:d].tobytes())
                counts.append(many[c:d].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at)), pa.array(sums, pa.list_(pa.int64())), pa.array(rests, pa.binary()),
                                              pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array([ids.itemsize] * batch.num_rows, pa.int32())],
                                             names=["doc_id", "n", "sums", "rest", "terms", "counts", "width"])

    coded = stages.write(documents(docs, id_col, text_col).mapInArrow(encode, "doc_id bigint, n bigint, sums array<bigint>, rest binary, terms binary, counts binary, width int"), "coded")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in slices(batches, 1024, 4 << 20):
            kind = f"<u{batch['width'][0].as_py()}"
            seen = np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), kind))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})

    facts = coded.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    # At most one row per id of the vocabulary.
    counts = coded.select("terms", "width").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1)
    df[counts["term"].to_numpy(np.int64)] = counts["df"]
    sent = docs.sparkSession.sparkContext.broadcast(np.log1p((facts["n"] - df + 0.5) / (df + 0.5)))
    frequent = docs.sparkSession.sparkContext.broadcast(df)
    mean = facts["mean"] or 1.0

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ``place``, the best term of each document that another one has, too, and ``parts``, the tasks its documents may go to."""
        idf, often = sent.value, frequent.value
        for batch in slices(batches, 1024, 4 << 20):
            places = []
            for terms, counts, n, width in zip(*(batch[c].to_pylist() for c in ("terms", "counts", "n", "width"))):
                term, tf = np.frombuffer(terms, f"<u{width}"), np.frombuffer(counts, "<u4")
                weight = np.where(often[term] > 1, idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean)), -1.0)
                best = int(np.argmax(weight))
                places.append(int(term[best]) if weight[best] >= 0 else -1)
            at = np.array(places, np.int64)
            parts = np.where(at < 0, len(often), np.ceil(often[at] / shard_docs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.maximum(parts, 1))], names=[*batch.schema.names, "place", "parts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, number = sent.value, TaskContext.get().partitionId() << _SEQUENCES
        rows: list[tuple] = []
        units: list[tuple[np.ndarray, tuple]] = []
        taken = 0

        def close(last: bool) -> None:
            nonlocal number, units, taken
            kept: list[tuple[np.ndarray, tuple]] = []
            if units:
                for pieces in fill(Shard(units, idf, mean, k1, b), window, last):
                    if pieces[-1][1] == ("open",):
                        kept = pieces[:-1]
                        continue
                    offset = 0
                    for ids, (doc, start, n, *_) in pieces:
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4")), n, number, offset))
                        offset += len(ids)
                    number += 1
            units, taken = kept, 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)
            rows.clear()
            return out

        for batch in slices(batches, 512, 4 << 20):
            for doc, n, sums, rest, terms, counts, width in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "sums", "rest", "terms", "counts", "width"))):
                for i, crc in enumerate(sums):
                    rows.append((doc, i * window, window, crc, n, number, 0))
                    number += 1
                if rest:
                    units.append((np.frombuffer(rest, f"<u{width}"), (doc, len(sums) * window, n, np.frombuffer(terms, f"<u{width}"), np.frombuffer(counts, "<u4"))))
                    taken += 1
                    if taken >= shard_docs:
                        close(False)
            if rows:
                yield flush()
        close(True)
        if rows:
            yield flush()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields)
    keyed = coded.mapInArrow(key, f"{fields}, place bigint, parts bigint").withColumn("part", F.pmod(F.xxhash64("doc_id", "rest"), F.col("parts")))
    laid = keyed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "part")
    laid = laid.sortWithinPartitions("place", "part", "doc_id", "n", F.xxhash64("rest", "sums"))
    return laid.select(*coded.columns).mapInArrow(pack, ", ".join(f"{n} bigint" for n in _PIECES.names))
