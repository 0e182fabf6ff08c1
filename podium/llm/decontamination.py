"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark's items. A block is two consecutive words (one, for patterns of
one word). The shift table tells how far a cursor may jump when it stands at the end of a block; where the shift is 0 the
block ends some pattern, its suffix bucket is searched for the fingerprint of the whole window, and the bytes of text and
pattern are compared. Many cursors, each in a stretch of its own, move at a time; words that are jumped over are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import Stages
from .common import col, row_key, slices
from .spans import bounds, places, spaced, strings
from .textvec import _LOWER, NOT_ALNUM, mix, text_bytes, word_spans

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
#: Keeps the last 0 to 8 of eight bytes, read as a little-endian number.
_LAST = np.array([0] + [(0xFFFFFFFFFFFFFFFF << 8 * (8 - n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)
_STRETCH = 256  # end positions that one cursor goes through

SCANNED = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, spans array<struct<start: bigint, length: bigint>>, items array<string>"


class Words:
    """Words of many texts, with codes that are made only for the words a search asks for."""

    def __init__(self, column: pa.Array, separators: np.ndarray = NOT_ALNUM) -> None:
        flat, offsets = text_bytes(column)
        self.flat = _LOWER[flat]
        self.starts, self.ends, self.text = word_spans(self.flat, offsets, separators)
        self.count = np.bincount(self.text, minlength=len(column))
        self._tails = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(8, np.uint8), self.flat]), 8)

    def codes(self, at: np.ndarray) -> np.ndarray:
        """64 bits from the last eight bytes and the length of each word."""
        size = self.ends[at] - self.starts[at]
        tail = np.ascontiguousarray(self._tails[self.ends[at]]).view(np.uint64)[:, 0] & _LAST[np.minimum(size, 8)]
        return mix(tail + size.astype(np.uint64) * _K)

    def block(self, at: np.ndarray, length: int) -> np.ndarray:
        """Code of the block that ends at each word."""
        return self.codes(at) if length == 1 else mix(self.codes(at - 1) * _K + self.codes(at))

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Code of the window of ``length`` words that ends at each word."""
        code = np.zeros(len(at), np.uint64)
        for back in range(length - 1, -1, -1):
            code = mix(code * _K + self.codes(at - back))
        return code

    def fingerprints(self, at: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
        """Suffix bucket (24 bits) and, inside it, the window's code (40 bits)."""
        return suffix >> _U(40) << _U(40) | self.whole(at, length) >> _U(24)

    def windows(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the windows that end at ``at``, words followed by a space each, and where each begins."""
        words = (at[:, None] + np.arange(1 - length, 1)).ravel()
        body, offsets = spaced(self.flat, self.starts[words], self.ends[words])
        return body, offsets[::length]


class Patterns:
    """Shift table, suffix buckets and bytes of distinct patterns of the same number of words."""

    def __init__(self, windows: pa.Array, length: int) -> None:
        words = Words(windows)
        self.length = length
        block = min(2, length)
        ends = np.arange(len(windows)) * length + length - 1
        self.bits = max(12, min(24, math.ceil(math.log2(16 * length * len(windows) + 1))))
        self.shift = np.full(1 << self.bits, length - block + 1, np.uint8)
        for back in range(length - block, -1, -1):  # the smallest shift of a block is written last
            self.shift[self._slot(words.block(ends - back, length))] = back
        prints = words.fingerprints(ends, words.block(ends, length), length)
        self.order = np.argsort(prints, kind="stable")
        self.prints = prints[self.order]
        self.body, self.offsets = words.windows(ends[self.order], length)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> _U(64 - self.bits)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word at which a pattern's occurrence ends, number of the pattern)."""
        length, n = self.length, np.maximum(words.count - self.length + 1, 0)
        pieces = -(-n // _STRETCH)
        owner = np.repeat(np.arange(len(n)), pieces)
        first = bounds(words.count)[:-1]
        at = first[owner] + length - 1 + places(np.zeros(len(n), np.int64), pieces) * _STRETCH
        stop = np.minimum(at + _STRETCH, first[owner] + words.count[owner])
        ends, numbers = [], []
        while len(at):
            suffix = words.block(at, length)
            step = self.shift[self._slot(suffix)]
            hit = step == 0
            if hit.any():
                for found in self._bucket(words, at[hit], suffix[hit]):
                    ends.append(found[0])
                    numbers.append(found[1])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(ends or [np.zeros(0, np.int64)]), np.concatenate(numbers or [np.zeros(0, np.int64)])

    def _bucket(self, words: Words, at: np.ndarray, suffix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        prints = words.fingerprints(at, suffix, self.length)
        low, high = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        candidate, at = places(low, high - low), np.repeat(at, high - low)
        for i in range(0, len(at), 1 << 16):
            some, ends = candidate[i : i + (1 << 16)], at[i : i + (1 << 16)]
            same = self._equal(words, ends, some)
            yield ends[same], self.order[some[same]]

    def _equal(self, words: Words, at: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Byte by byte."""
        body, offsets = words.windows(at, self.length)
        size = self.offsets[candidate + 1] - self.offsets[candidate]
        same = np.diff(offsets) == size
        begin = offsets[:-1][same]
        differ = body[places(begin, size[same])] != self.body[places(self.offsets[candidate[same]], size[same])]
        wrong = np.add.reduceat(differ, bounds(size[same])[:-1]) > 0 if len(begin) else np.zeros(0, bool)
        same[same] = ~wrong
        return same


class Block:
    """A bounded part of the (window, item) pairs: patterns by number of words, and the items of each."""

    def __init__(self, pairs: pa.Table) -> None:
        self.items = np.array(sorted({i for i in pairs["item"].to_pylist() if i is not None}), object)
        rank = {item: n for n, item in enumerate(self.items)}
        self.patterns, self._postings = [], []
        for length in sorted(set(pairs["n"].to_pylist())):
            some = pairs.filter(pc.equal(pairs["n"], length))
            coded = some["win"].combine_chunks().dictionary_encode()
            item = np.array([rank.get(i, -1) for i in some["item"].to_pylist()], np.int64)
            number = coded.indices.to_numpy()
            order = np.lexsort((item, number))
            named = order[item[order] >= 0]
            self.patterns.append(Patterns(coded.dictionary, length))
            self._postings.append((item[named], np.searchsorted(number[named], np.arange(len(coded.dictionary) + 1))))

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """Per text: number of words, hit stretches as (start, length) in words, items with occurring windows, sorted."""
        words = Words(column)
        first = bounds(words.count)
        open_ = np.zeros(len(words.text) + 1, np.int64)
        hits: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k, patterns in enumerate(self.patterns):
            end, number = patterns.find(words)
            np.add.at(open_, end + 1 - patterns.length, 1)
            np.add.at(open_, end + 1, -1)
            if len(end):
                both = np.unique(np.stack([words.text[end], number]), axis=1)
                hits.append((both[0], both[1], k))
        hit = np.cumsum(open_)[:-1] > 0
        new = np.ones(len(hit), bool)
        new[1:] = (words.text[1:] != words.text[:-1]) | ~hit[:-1]
        last = np.ones(len(hit), bool)
        last[:-1] = new[1:] | ~hit[1:]
        begin, end = np.flatnonzero(hit & new), np.flatnonzero(hit & last) + 1
        of = words.text[begin]
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        for t, a, n in zip(of.tolist(), (begin - first[of]).tolist(), (end - begin).tolist()):
            spans[t].append({"start": a, "length": n})
        ranks: dict[int, list[np.ndarray]] = {}
        for texts, numbers, k in hits:
            item, cut = self._postings[k]
            for t, p in zip(texts.tolist(), numbers.tolist()):
                ranks.setdefault(t, []).append(item[cut[p] : cut[p + 1]])
        items: list[list[str]] = [[] for _ in range(len(column))]
        for t, parts in ranks.items():
            items[t] = self.items[np.unique(np.concatenate(parts))].tolist()
        return words.count, spans, items


_built: list[tuple[object, Block]] = []


def _block(sent: Broadcast) -> Block:
    """Tables of a block, built once per process and broadcast."""
    if not _built or _built[0][0] is not sent.value:
        _built[:] = [(sent.value, Block(sent.value))]
    return _built[0][1]


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (win: the words of a window, each followed by a space, n: how many, item) of all items."""
    read = benchmark.select(col(id_col).cast("string").alias("item"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 1 << 20):
            words = Words(batch["text"])
            first = bounds(words.count)[:-1]
            for length in range(1, size + 1):
                some = np.flatnonzero(words.count >= length if length == size else words.count == length)
                n = words.count[some] - length + 1
                ends = places(first[some] + length - 1, n)
                for at in range(0, len(ends), 1 << 16):
                    part, owner = ends[at : at + (1 << 16)], np.repeat(some, n)[at : at + (1 << 16)]
                    body, offsets = words.windows(part, length)
                    yield pa.RecordBatch.from_arrays([strings(body, offsets), pa.array(np.full(len(part), length, np.int32)), batch["item"].take(pa.array(owner))],
                                                     names=["win", "n", "item"])

    return read.mapInArrow(cut, "win string, n int, item string").distinct()


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], s["start"] + s["length"] - out[-1]["start"])
        else:
            out.append(dict(s))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, k1, k2 (key of the row), n_words, spans (hit stretches: start and length in words, apart
    and in order), items (ids of the items with occurring windows, as sorted strings).

    Words are letters and digits, A-Z lowered, and all characters beyond ASCII. A window is ``size`` consecutive words of an
    item; a shorter item is one window. A word inside any occurrence of a window is hit.

    The (window, item) pairs are dealt by hash into blocks of about ``block_rows``, so a window that very many items share is
    spread, too. One block's tables go to all tasks (some 100 bytes a pair, a bound that does not depend on the data) and all
    documents are scanned once per block; from the second block on only documents with hits travel.

    Null text has no words. Null ids are rows like others. Items with null id hit words, but are not listed; items that share
    an id are one. Repeated rows are reported each. Texts of any length are scanned whole, a text in one task. An empty
    benchmark hits nothing, an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "decontamination")
    pairs = stages.write(windows(benchmark, size, item_col, item_text_col), "windows")
    n = max(1, -(-pairs.count() // block_rows))
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), *row_key(id_col, text_col), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = None
    for number in range(n):
        part = pairs.filter(F.pmod(F.xxhash64("win", "item", F.lit(7)), F.lit(n)) == number)
        sent = spark.sparkContext.broadcast(part.toArrow().combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _block(sent)
            for batch in slices(batches, 2048, 4 << 20):
                count, spans, items = block.scan(batch["text"])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(count), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                                                 names=["doc_id", "k1", "k2", "n_words", "spans", "items"])

        scanned = read.mapInArrow(scan, SCANNED)
        found = scanned if found is None else _both(found, scanned)
    stages.drop("windows")
    return found


def _both(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` with the hits of a further block. Repeated rows have equal hits."""
    more = more.filter(F.size("spans") > 0).groupBy("k1", "k2").agg(F.first("spans").alias("more_spans"), F.first("items").alias("more_items"))
    rows = found.join(more.hint("merge"), ["k1", "k2"], "left")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            spans = [merged([*a, *(b or [])]) for a, b in zip(batch["spans"].to_pylist(), batch["more_spans"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "k1", "k2", "n_words")), pa.array(spans, batch["spans"].type), batch["items"]],
                                             names=["doc_id", "k1", "k2", "n_words", "spans", "items"])

    items = F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>"))))
    return rows.select("doc_id", "k1", "k2", "n_words", "spans", "more_spans", items.alias("items")).mapInArrow(unite, SCANNED)


def drop_hits(docs: DataFrame, benchmark: DataFrame, least_words: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of which ``least_words`` or more words are hit; columns as they are, null texts stay."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter(hit >= least_words).select(F.struct("k1", "k2").alias("key")).distinct()
    key = "_key"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.struct(*row_key(id_col, text_col)))
    return rows.join(found.hint("merge"), rows[key] == found["key"], "left_anti").select(*map(col, docs.columns))
