"""Fuzzy line de-duplication: one-permutation MinHash over character shingles, banding, exact confirmation, union-find."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import Stages
from .common import col, dealt_anew, row_key, slices, unused
from .components import components
from .hamming import _edges_of, _groups, blocked, confirm, group_roots
from .spans import bounds, places, strings
from .textvec import _LOWER, mix, span_hashes, text_bytes

#: At similarity 0.8 two lines share a band with probability 0.9996, at 0.5 with 0.47, at 0.3 with 0.05.
BANDS, ROWS = 20, 5
#: A changed byte breaks five shingles, so lines from 49 bytes on stay similar with one changed inside.
SHINGLE = 5
_MASK = (1 << 8 * SHINGLE) - 1
_MARK_BITS = 27
_LEAST_BITS = 128  # of the bitmaps that are compared before two lines become suspects
_TOGETHER = 8  # lines of a bucket of which every pair is a row
_PAIR = np.dtype([("key", "<u4"), ("node", "<u8")])
_EDGE = np.isin(np.arange(256), [9, 11, 12, 13, 32])


def line_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every line between line feeds, empty ones too."""
    feeds = np.flatnonzero(flat == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    text = np.repeat(np.arange(len(offsets) - 1), np.bincount(np.searchsorted(offsets, feeds, "right") - 1, minlength=len(offsets) - 1) + 1)
    ends = np.empty(len(starts), np.int64)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends[last] = offsets[1:]
    ends[~last] = feeds
    return starts, ends, text


def trimmed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the blanks at their edges."""
    starts, ends = starts.copy(), ends.copy()
    if not len(flat):
        return starts, ends
    open_ = ends > starts
    while (hit := open_ & _EDGE[flat[np.minimum(starts, len(flat) - 1)]] & (ends > starts)).any():
        starts[hit] += 1
        open_ = hit
    open_ = ends > starts
    while (hit := open_ & _EDGE[flat[np.maximum(ends - 1, 0)]] & (ends > starts)).any():
        ends[hit] -= 1
        open_ = hit
    return starts, ends


def windows(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle: its bytes as a number, span number) at every place of each span, in order. A-Z are lowered.

    Spans are as long as a shingle at least.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a, b = int(starts[0]), int(ends[-1])
    low = np.zeros(b - a + 8, np.uint8)
    low[: b - a] = _LOWER[flat[a:b]]
    value = np.ndarray((b - a,), "<u8", low, strides=(1,)) & np.uint64(_MASK)
    n = ends - starts - SHINGLE + 1
    return value[places(starts - a, n)], np.repeat(np.arange(len(starts)), n)


def shingles(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle as a mixed number, span number) of the distinct shingles of each of fewer than 2 ** 24 spans, by span."""
    value, owner = windows(flat, starts, ends)
    key = np.sort(value | owner.astype(np.uint64) << np.uint64(8 * SHINGLE))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return mix(key & np.uint64(_MASK)), (key >> np.uint64(8 * SHINGLE)).astype(np.int64)


_OTHERS = np.random.default_rng(11).integers(0, BANDS * ROWS, (32, BANDS * ROWS))


def band_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys. Each shingle falls into one of the signature's places by its hash, and the least of a place is its symbol.

    A place without a shingle takes another one's symbol, by a fixed random order of its own, so that the bands of short lines
    do not all hold the same few shingles. After 32 tries it goes on to the next places in turn.
    """
    size = BANDS * ROWS
    value, owner = windows(flat, starts, ends)
    h = mix(value)
    least = np.full(len(starts) * size, 0xFFFFFFFF, np.uint32)
    place = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    np.minimum.at(least, owner * size + place.astype(np.int64), h.astype(np.uint32) >> np.uint32(1))
    empty, tries = np.flatnonzero(least == 0xFFFFFFFF), 0
    symbols = least.copy()
    while len(empty):
        at = empty % size
        other = _OTHERS[tries, at] if tries < len(_OTHERS) else (at + tries - len(_OTHERS) + 1) % size
        symbols[empty] = least[empty - at + other]
        empty, tries = empty[symbols[empty] == 0xFFFFFFFF], tries + 1
    symbols = symbols.reshape(len(starts), size).astype(np.uint64)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, band * ROWS + row])
        keys[:, band] = key
    return keys.view(np.int64)


def sketches(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of distinct shingles; bitmap of at least twice as many bits, a power of two) of each line.

    Every shingle sets a bit. A bit that only one of two lines has set stands for a shingle that only one has, and it
    stays so when a bitmap is folded to half its size.
    """
    h, owner = shingles(flat, starts, ends)
    n = np.bincount(owner, minlength=len(starts))
    width = np.maximum(_LEAST_BITS, 1 << np.ceil(np.log2(2 * n)).astype(np.int64))
    at = bounds(width)
    bits = np.zeros(at[-1], bool)
    bits[at[owner] + (h & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    body = np.packbits(bits, bitorder="little")
    return n, pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at // 8), pa.py_buffer(body)]).cast(pa.binary())


class Sketches:
    """Bitmaps of several sizes, compared two by two at the size of the smaller one."""

    def __init__(self, n: np.ndarray, bits: pa.Array, percent: int) -> None:
        self.n, self.percent = n, percent
        data, offsets = np.frombuffer(bits.buffers()[2], np.uint64), np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1] // 8
        self.width = np.diff(offsets)
        self.of, self.place = {}, {}
        for width in np.unique(self.width).tolist()[::-1]:
            own = np.flatnonzero(self.width == width)
            sets, members = [data[offsets[own][:, None] + np.arange(width)]], [own]
            if 2 * width in self.of:  # similar lines differ by less than a factor of two
                wide = self.of[2 * width][: (self.width == 2 * width).sum()]
                sets.append(wide[:, :width] | wide[:, width:])
                members.append(np.flatnonzero(self.width == 2 * width))
            self.of[width] = np.concatenate(sets)
            self.place[width] = np.full(len(n), -1)
            self.place[width][np.concatenate(members)] = np.arange(len(self.of[width]))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether lines a[i] and b[i] may be similar: sets that are have at most (|A| + |B|) * (100 - percent) / (100 + percent) elements
        that only one has."""
        small = np.minimum(self.width[a], self.width[b])
        sized = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        close = sized & (np.maximum(self.width[a], self.width[b]) <= 2 * small)
        out = sized & ~close  # none where percent is 50 or more; not compared otherwise
        for width in np.unique(small[close]).tolist():
            some = np.flatnonzero(close & (small == width))
            for i in range(0, len(some), 1 << 14):
                part = some[i : i + (1 << 14)]
                x, y = self.of[width][self.place[width][a[part]]], self.of[width][self.place[width][b[part]]]
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                out[part] = apart * (100 + self.percent) <= (self.n[a[part]] + self.n[b[part]]) * (100 - self.percent)
        return out


def line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character shingles of whole lines, for exact confirmation."""
    flat, offsets = text_bytes(column)
    long = np.flatnonzero(np.diff(offsets) >= SHINGLE)
    h, owner = shingles(flat, offsets[:-1][long], offsets[1:][long])
    return h, np.searchsorted(long[owner], np.arange(len(column) + 1))


def _lines(column: pa.Array) -> tuple:
    """Lines that are not blank: (all bytes, starts and text numbers of all lines, trimmed starts and ends, places among all lines)."""
    flat, offsets = text_bytes(column)
    starts, ends, text = line_spans(flat, offsets)
    a, b = trimmed(flat, starts, ends)
    live = np.flatnonzero(b > a)
    return flat, starts, text, a[live], b[live], live


class _Seen:
    """The nodes met lately, in ascending order; beyond ``limit`` it starts anew."""

    def __init__(self, limit: int = 200_000) -> None:
        self.limit, self.nodes = limit, np.zeros(0, np.uint64)

    def add(self, nodes: np.ndarray) -> np.ndarray:
        """Which of the ascending, distinct ``nodes`` are new; they are remembered."""
        at = np.searchsorted(self.nodes, nodes)
        new = self.nodes[np.minimum(at, len(self.nodes) - 1)] != nodes if len(self.nodes) else np.ones(len(nodes), bool)
        self.nodes = nodes[new] if len(self.nodes) > self.limit else np.insert(self.nodes, at[new], nodes[new])
        return new


def _fresh(column: pa.Array, least: int, seen: _Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, starts, ends, nodes) of lines of ``least`` bytes or more, but for copies of those seen lately.

    Copies are one node, so any of them will do.
    """
    flat, _, _, a, b, _ = _lines(column)
    long = np.flatnonzero(b - a >= least)
    h1 = span_hashes(flat, a[long], b[long])
    new, first = np.unique(h1, return_index=True)
    first = np.sort(first[seen.add(new)])
    return flat, a[long[first]], b[long[first]], h1[first]


def _dealt(keys: np.ndarray, nodes: np.ndarray, cells: int) -> pa.RecordBatch:
    """(cell, pairs): the keys and their nodes, a row per cell of keys. 32 bits stand for a key in its cell."""
    cell = ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.uint16)
    order = np.argsort(cell, kind="stable")
    pairs = np.empty(len(keys), _PAIR)
    pairs["key"], pairs["node"] = keys[order].astype(np.uint32), nodes[order]
    cell = cell[order]
    cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    at = np.append(cut, len(cell)).astype(np.int32) * np.int32(_PAIR.itemsize)
    body = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(at), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays([pa.array(cell[cut].astype(np.int32)), body], names=["cell", "pairs"])


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of rows as ``_dealt`` makes them; a key is its cell's number and its 32 bits."""
    body = batch["pairs"]
    at = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1] // _PAIR.itemsize
    pairs = np.frombuffer(body.buffers()[2], _PAIR, at[-1])[at[0] :]
    return np.repeat(batch["cell"].to_numpy().astype(np.int64) << 32, np.diff(at)) | pairs["key"], pairs["node"]


class Buckets:
    """Finds the buckets of two or more nodes among (key, node) that come in the order of their cells.

    Whole cells are looked at together, about ``limit`` keys at a time. Of a cell with more than that, nodes of shared keys are told at once and
    each key is kept with one node, so memory is bounded by the distinct keys of a cell, however large a bucket is.
    """

    def __init__(self, limit: int = 1 << 20) -> None:
        self.limit = limit
        self.key, self.node, self.told = [], [], []
        self.rows = 0

    def add(self, key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._hold(key, node, np.zeros(len(key), bool))
        if self.rows >= self.limit:
            held = self._take()
            ready = held[0] >> 32 < key[-1] >> 32
            yield from self._tell(*(x[ready] for x in held), whole=True)
            held = [x[~ready] for x in held]
            if len(held[0]) >= self.limit:
                yield from self._tell(*held, whole=False)
                self.limit = max(self.limit, 2 * self.rows)  # distinct keys: look again when as many have come
            else:
                self._hold(*held)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from self._tell(*self._take(), whole=True)

    def _hold(self, key: np.ndarray, node: np.ndarray, told: np.ndarray) -> None:
        self.key.append(key)
        self.node.append(node)
        self.told.append(told)
        self.rows += len(key)

    def _take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in (self.key, self.node, self.told)]
        self.key, self.node, self.told, self.rows = [], [], [], 0
        return out

    def _tell(self, key: np.ndarray, node: np.ndarray, told: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        alone = order[~(np.append(same, False) | np.append(False, same))]
        some = order[np.append(same, False) | np.append(False, same)]  # few: only these are ordered by node
        some = some[np.lexsort((~told[some], node[some].view(np.int64), key[some]))]
        k, n, t = key[some], node[some].view(np.int64), told[some]
        once = np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))[: len(k)]  # each node of a key once
        k, n, t = k[once], n[once], t[once]
        cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)]), len(k))
        size = np.diff(cut)
        if not whole:  # one node of each key stays: the lone one, or the first of those that are told
            first = cut[:-1]
            self._hold(np.append(key[alone], k[first]), np.append(node[alone], n[first].view(np.uint64)), np.append(told[alone], t[first] | (size > 1)))
        crowd = np.repeat((size > 1) & (np.logical_or.reduceat(t, cut[:-1]) if len(k) else False) | (size > 1) & (not whole), size)
        size = np.repeat(size, size)
        out = [(k[i], None, n[i], None) for i in [np.flatnonzero(crowd & ~t)]]
        out += [(k[i], size[i], n[i], None) for i in [np.flatnonzero(~crowd & (size > _TOGETHER))]] if whole else []
        few = ~crowd & (size <= _TOGETHER)
        for step in range(1, min(_TOGETHER, len(k)) if whole else 0):
            i = np.flatnonzero(few[step:] & (k[step:] == k[: len(k) - step]))
            out.append((None, None, n[i], n[i + step]))
        for columns in out:
            rows = len(columns[2])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=["key", "size", "a", "b"])


def _meetings(texts: DataFrame, least: int) -> DataFrame:
    """(key, size, a, b): the buckets of two or more lines, by band key. Of up to _TOGETHER lines, each pair is a row: a and b.

    Lines of larger ones are rows with key, size and a. The size is null where it has to be counted yet.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(64 * parts, 1 << 16)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, rows = _Seen(), [], [], 0
        for batch in slices(batches, 512, 1 << 20):
            flat, a, b, node = _fresh(batch["text"], least, seen)
            keys.append(band_keys(flat, a, b).ravel().view(np.uint64))
            nodes.append(np.repeat(node, BANDS))
            rows += len(keys[-1])
            if rows >= 1 << 20:
                yield _dealt(np.concatenate(keys), np.concatenate(nodes), cells)
                keys, nodes, rows = [], [], 0
        if rows:
            yield _dealt(np.concatenate(keys), np.concatenate(nodes), cells)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            if batch.num_rows:
                yield from buckets.add(*_pairs(batch))
        yield from buckets.close()

    keys = texts.mapInArrow(sign, "cell int, pairs binary")
    return keys.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "key bigint, size bigint, a bigint, b bigint")


def _suspects(stages: Stages, texts: DataFrame, met: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): links within buckets between lines that may be similar. No similar pair of a bucket is lost.

    What their bitmaps rule out is not similar. Pairs of small buckets are compared once, in however many buckets they meet; the members of a
    larger one that are connected are linked with its first one.
    """
    pairs = stages.write(met.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    large = met.filter("b IS NULL").select("key", "size", F.col("a").alias("node"))
    wanted = _marks(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in slices(batches, 512, 1 << 20):
            flat, a, b, node = _fresh(batch["text"], least, seen)
            some = _marked(wanted.value, node)
            a, b, node = a[some], b[some], node[some]
            n, bits = sketches(flat, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n), bits], names=["node", "n", "bits"])

    # Tasks send few copies of their own, so they are not sorted before the shuffle.
    drawn = texts.mapInArrow(sketch, "node bigint, n bigint, bits binary").repartition("node").groupBy("node").agg(F.max("n").alias("n"), F.first("bits").alias("bits"))
    drawn = stages.write(drawn, "drawn")

    def compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14, 8 << 20):
            rows = batch.num_rows
            two = Sketches(np.append(batch["n_a"], batch["n_b"]), pa.concat_arrays([batch["bits_a"], batch["bits_b"]]), percent)
            near = np.flatnonzero(two.near(np.arange(rows), np.arange(rows) + rows))
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(near)), batch["b"].take(pa.array(near))], names=["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(drawn.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    close = pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(compare_pairs, "a bigint, b bigint")

    uncounted = large.filter("size IS NULL").select("key", "node").distinct()
    size = dealt_anew(uncounted.groupBy("key").agg(F.count("*").alias("size")), "key")
    large = large.filter("size IS NOT NULL").unionByName(uncounted.join(size.hint("merge"), "key"))
    rows = blocked(large, "key", "node", "size").join(drawn.hint("merge"), "node")
    order = ["key", "_i", "_j"]
    laid = rows.select(*order, "node", "n", "bits").repartition(*order).sortWithinPartitions(*order, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, order):
            cut = _edges_of([table[c].to_numpy() for c in order])
            node = table["node"].to_numpy()
            bits = table["bits"].combine_chunks()
            bits = bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits
            drawn = Sketches(table["n"].to_numpy(), bits, percent)
            root = group_roots(cut, drawn.near, lambda at, end: lambda i, others: drawn.near(np.full(len(others), at + i), at + others))
            some = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[some]]), pa.array(node[some])], names=["a", "b"])

    return close.unionByName(laid.mapInArrow(compare, "a bigint, b bigint")).distinct()


def _marked(marks: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = (node >> np.uint64(64 - _MARK_BITS)).astype(np.int64)
    return np.flatnonzero(marks[at >> 3] >> (at & 7) & 1)


def _marks(nodes: DataFrame) -> Broadcast:
    """A bitmap of 2 ** _MARK_BITS bits (16 MB, of words by the driver, whatever the input) over the first bits of the nodes.

    It spares most other lines the way to the join; with very many nodes it lets all pass, and the join decides as ever.
    """
    place = f"shiftrightunsigned(node, {64 - _MARK_BITS})"
    rows = nodes.groupBy(F.expr(f"{place} div 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 AS INT)))").alias("bits")).toArrow()
    marks = np.zeros(1 << _MARK_BITS - 6, "<i8")
    marks[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(marks.view(np.uint8))


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_chars: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_lines, dropped (numbers of its lines that go, from 0, ascending), k1, k2, the key of the row.

    Lines are taken without blanks at their edges; blank ones always stay. Lines are equal when 128 bits of hash are (A-Z
    lowered), however short they are, and similar when the sets of their character shingles are, as confirmed on the
    full sets. Lines of fewer than ``min_chars`` bytes or without a shingle are only compared as a whole. Of each component of equal
    and similar lines the first one stays: smallest doc_id, then smallest line number.

    Lines whose signatures share a band meet in its bucket. Where bitmaps of their shingles rule out that they are similar, they are
    no suspects; connected suspects are families, and within a family all full sets are compared.

    Null text is empty: one empty line. Null ids come after all others. Repeated rows (same id and text) are one document here and keep
    the same lines. Texts and lines of any length are read whole; a text is in one task. An empty table gives no rows. Other
    columns are ignored.
    """
    stages = Stages(docs.sparkSession, "line-dedup")
    least = max(min_chars, SHINGLE)
    text = F.coalesce(col(text_col), F.lit(""))
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), *row_key(id_col, text_col), text.alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 1 << 20):
            flat, starts, owner, a, b, live = _lines(batch["text"])
            h1 = span_hashes(flat, a, b)
            h2 = mix(h1 ^ _second(flat, a, b))
            n, of = batch.num_rows, owner[live]
            cut = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            begin = np.searchsorted(owner, np.arange(n))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in ((live - begin[of]).astype(np.int32), h1.view(np.int64), h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(np.bincount(owner, minlength=n)), *lists],
                                             names=["doc_id", "k1", "k2", "n_lines", "number", "h1", "h2"])

    met = stages.write(_meetings(read.select("text"), least), "met")
    suspects = stages.write(_suspects(stages, read.select("text"), met, least, percent), "suspects")
    stages.drop("met", "pairs", "drawn")
    families = components(suspects, "line-dedup-families").select("node", F.col("root").alias("family"))
    families = stages.write(families, "families")

    wanted = _marks(families)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in slices(batches, 512, 1 << 20):
            flat, a, b, node = _fresh(batch["text"], least, seen)
            some = _marked(wanted.value, node)
            a, b, node = a[some], b[some], node[some]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), strings(flat[places(a, b - a)], bounds(b - a))], names=["node", "text"])

    # A line's text travels only to meet the list of suspects; the list is the build side, as it is narrow and has each node once.
    found = read.select("text").mapInArrow(texts, "node bigint, text string").join(families.hint("shuffle_hash"), "node")
    members = stages.write(found.groupBy("node", "family").agg(F.first("text").alias("text")), "members")
    links = stages.write(confirm(members, line_sets, percent), "links")
    stages.drop("suspects", "families", "members")
    roots = stages.write(components(links, "line-dedup-components"), "roots")
    stages.drop("links")

    schema = "doc_id bigint, k1 bigint, k2 bigint, n_lines bigint, number array<int>, h1 array<bigint>, h2 array<bigint>"
    rows = stages.write(read.mapInArrow(number, schema), "lines")
    # Only lines that have a copy or a similar one meet again: by their node, or their component's, and the second hash of copies.
    copies = rows.select(F.explode("h1").alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    wanted = stages.write(copies.join(roots.hint("merge"), "node", "full").select("node", "root"), "wanted")
    lines = rows.select("doc_id", "k1", "k2", F.explode(F.arrays_zip("number", "h1", "h2")).alias("l"))
    lines = lines.select("doc_id", "k1", "k2", F.col("l.number").alias("number"), F.col("l.h1").alias("node"), F.col("l.h2").alias("h2"))
    lines = lines.join(wanted.hint("merge"), "node").select("doc_id", "k1", "k2", "number", F.coalesce("root", "node").alias("root"),
                                                            F.when(F.col("root").isNull(), F.col("h2")).otherwise(0).alias("h2"))
    lines = stages.write(lines, "again")
    stages.drop("roots", "wanted")
    same = ["root", "h2"]
    first = lines.groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "k1", "k2", "number")).alias("f"), F.count("*").alias("n"))
    first = dealt_anew(first.filter("n > 1").select(*same, F.struct("f.k1", "f.k2", "f.number").alias("first")), *same)
    gone = lines.drop("doc_id").join(first.hint("merge"), same).filter(F.struct("k1", "k2", "number") != F.col("first"))
    gone = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("number")).alias("dropped"))
    out = rows.select("doc_id", "n_lines", "k1", "k2").join(gone.hint("merge"), ["k1", "k2"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), "k1", "k2")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` without the duplicate lines, other columns and rows as they are; ``length_col`` gets the new length.

    A document that loses all its lines stays as a row with what is left of its text, so that rows can be followed. Null texts
    stay null; repeated rows keep the same lines; an empty table stays empty; columns may have any names.
    """
    found = line_duplicates(docs, id_col, text_col, **options).filter(F.size("dropped") > 0).select(F.struct("k1", "k2").alias("k"), "dropped")
    found = found.groupBy("k").agg(F.first("dropped").alias("dropped"))
    key, gone = unused(docs, "key"), unused(docs, "gone")
    found = found.select(F.col("k").alias(key + "_"), F.col("dropped").alias(gone))
    rows = docs.withColumn(key, F.struct(*row_key(id_col, text_col))).join(found.hint("merge"), F.col(key) == F.col(key + "_"), "left")
    kept = F.array_join(F.filter(F.split(col(text_col), "\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n")
    touched = F.col(gone).isNotNull()
    new = {text_col: F.when(touched, kept).otherwise(col(text_col))}
    if length_col:
        new[length_col] = F.when(touched, F.length(kept).cast(docs.schema[length_col].dataType)).otherwise(col(length_col))
    return rows.select(*(new[c].alias(c) if c in new else col(c) for c in docs.columns))


def _second(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 and length of each span, A-Z lowered: independent of the first hash."""
    low = _LOWER[flat].tobytes()
    view = memoryview(low)
    return np.array([zlib.crc32(view[a:b]) << 32 | (b - a) & 0xFFFFFFFF for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
