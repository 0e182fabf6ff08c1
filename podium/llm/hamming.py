"""MinHash signatures of b-bit symbols, their multi-index Hamming join, and exact confirmation within families.

Two sets of Jaccard similarity j agree in a symbol with probability j (and hardly more). A signature of ``chunks`` x ``width``
symbols is indexed by its chunks: up to ``errors`` symbols of a chunk may differ, so every choice of the others is
a key. By the pigeonhole principle two signatures that differ in at most chunks * (errors + 1) - 1 symbols share a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import dealt_anew
from .spans import bounds, places
from .textvec import mix

_BLOCK = 512  # members of a bucket or family that one group may hold; larger ones are compared block by block
_FEW, _AT_ONCE = 16, 4 << 20  # members of a family whose pairs are looked up one by one; bytes of text of families taken together


@dataclass(frozen=True)
class Index:
    """Shape of signatures. ``differ``: symbols in which two signatures may differ to be suspects at all."""

    chunks: int
    width: int
    errors: int
    differ: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def guaranteed(self) -> int:
        """Every pair of signatures at this distance or nearer shares a key."""
        return self.chunks * (self.errors + 1) - 1

    def signatures(self, items: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """16-bit symbols of the sets ``items[cut[i]:cut[i + 1]]`` of 64-bit hashes; none may be empty."""
        rng = np.random.default_rng(5)
        factor = rng.integers(1, 1 << 31, self.symbols, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shift = rng.integers(0, 1 << 32, self.symbols, dtype=np.uint32)
        low = (items >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(cut) - 1, self.symbols), np.uint32)
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            best = None
            for at in range(a, b, 2048):
                part = (low[at : min(at + 2048, b)] * factor[:, None] + shift[:, None]).min(1)
                best = part if best is None else np.minimum(best, part)
            out[i] = best
        return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(sets, keys) of 64-bit keys, one per chunk and choice of symbols that must agree."""
        symbols = signatures.astype(np.uint64).reshape(len(signatures), self.chunks, self.width)
        out = []
        for chunk in range(self.chunks):
            for n, kept in enumerate(combinations(range(self.width), self.width - self.errors)):
                key = np.full(len(signatures), chunk * 1000 + n, np.uint64)
                for i in kept:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, chunk, i])
                out.append(key)
        return np.stack(out, 1).view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal ``names`` from sorted batches, many groups to a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch[n].to_numpy(zero_copy_only=False) for n in names]
        new = np.any([x[1:] != x[:-1] for x in ids], axis=0)
        at = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if held and any(held[-1][n][-1] != batch[n][0] for n in names):
            yield pa.Table.from_batches(held)
            held = []
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _edges_of(ids: list[np.ndarray]) -> np.ndarray:
    new = np.any([x[1:] != x[:-1] for x in ids], axis=0) if len(ids[0]) > 1 else np.zeros(0, bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(ids[0])]])


def local_roots(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Root (smallest place) of each of ``n`` places; ``near(i, others)`` says which others are linked with i.

    Only places that nothing has reached yet are asked for, so a group around a common origin costs little more than its size.
    """
    root, todo = np.arange(n), np.arange(n)
    while len(todo):
        first, todo = todo[0], todo[1:]
        front = [first]
        while front and len(todo):
            hit = near(front.pop(), todo)
            found = todo[hit]
            root[found] = first
            front += found.tolist()
            todo = todo[~hit]
    return root


def blocked(rows: DataFrame, group: str, member: str, n: str) -> DataFrame:
    """Spread groups of more than a block over (i, j) pairs of blocks; every two members meet in one pair at least.

    ``n`` is the number of rows of the group. A group of b blocks has b * (b + 1) / 2 parts of at most two blocks, and each
    member goes to b of them. No pairs of members are made here.
    """
    blocks = F.ceil(F.col(n) / _BLOCK).cast("int")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o")


def suspects(items: DataFrame, index: Index) -> DataFrame:
    """(a, b): links within buckets between signatures that differ in at most ``index.differ`` symbols.

    ``items``: node long (unique), keys array<long>, sig binary (a byte per symbol). A bucket of suspects connected
    to each other is reported as a star around its smallest node, never pair by pair.
    """
    keys = items.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keys.join(dealt_anew(shared, "key").hint("merge"), "key").join(items.select("node", "sig").hint("merge"), "node")
    rows = blocked(rows, "key", "node", "n").select("key", "_i", "_j", "node", "sig")
    order = ["key", "_i", "_j"]
    laid = rows.repartition(*order).sortWithinPartitions(*order, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, order):
            ids = [table[n].to_numpy() for n in order]
            node = table["node"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
            cut = _edges_of(ids)
            size = np.diff(cut)
            a, b = [], []
            two = cut[:-1][size == 2]
            near = (sig[two] != sig[two + 1]).sum(1) <= index.differ
            a.append(node[two[near]])
            b.append(node[two[near] + 1])
            for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                part = sig[at : at + n]
                root = local_roots(n, lambda i, others: (part[others] != part[i]).sum(1) <= index.differ)
                some = np.flatnonzero(root != np.arange(n))
                a.append(node[at + root[some]])
                b.append(node[at + some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return laid.mapInArrow(compare, "a bigint, b bigint").distinct()


Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def confirm(members: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(a, b): exact links within families, as stars around the smallest node of each connected part.

    ``members``: family long, node long, text string. ``sets`` gives (distinct hashes of all texts, where each text's
    begin and the end). Intersections of all members of a part are counted, in large ones by matrix products over the elements that
    two or more of them have; members are linked where 100 * intersection >= percent * union.
    """
    size = members.groupBy("family").agg(F.count("*").alias("n"))
    rows = blocked(members.hint("merge").join(dealt_anew(size, "family"), "family"), "family", "node", "n").select("family", "_i", "_j", "_b", "node", "text")
    order = ["family", "_i", "_j"]
    laid = rows.repartition(*order).sortWithinPartitions(*order, "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, order):
            cut = _edges_of([table[n].to_numpy() for n in order])
            node = table["node"].to_numpy()
            sizes = pc.binary_length(table["text"]).to_numpy()
            ahead = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[cut]
            first = 0
            while first < len(cut) - 1:  # whole families, about _AT_ONCE bytes of text at a time
                last = max(first + 1, int(np.searchsorted(ahead, ahead[first] + _AT_ONCE, "right")) - 1)
                at, part = cut[first], cut[first : last + 1] - cut[first]
                texts = table["text"].slice(at, part[-1]).combine_chunks()
                root = family_roots(*sets(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts), part, percent)
                some = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[at + root[some]]), pa.array(node[at + some])], names=["a", "b"])
                first = last

    return laid.mapInArrow(verify, "a bigint, b bigint")


def family_roots(items: np.ndarray, begin: np.ndarray, cut: np.ndarray, percent: int) -> np.ndarray:
    """Smallest place each set is connected with inside its family ``cut[f]:cut[f + 1]``, by similar pairs.

    Families of up to _FEW members go through all their pairs together, larger ones through a matrix of their own.
    """

    def matrix(at: int, end: int) -> Callable[[int, np.ndarray], np.ndarray]:
        links = linked(items[begin[at] : begin[end]], begin[at : end + 1] - begin[at], percent)
        return lambda i, others: links[i, others]

    return group_roots(cut, lambda a, b: similar_pairs(items, begin, a, b, percent), matrix)


def group_roots(cut: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], one: Callable[[int, int], Callable[[int, np.ndarray], np.ndarray]]) -> np.ndarray:
    """Smallest place each place is connected with inside its group ``cut[g]:cut[g + 1]``.

    Groups of up to _FEW members go through all their pairs together: ``near(a, b)``. ``one(at, end)`` gives the test for a larger one.
    """
    n, size = int(cut[-1]), np.diff(cut)
    root = np.arange(n)
    for g in np.flatnonzero(size > _FEW).tolist():
        at, end = int(cut[g]), int(cut[g + 1])
        root[at:end] = at + local_roots(end - at, one(at, end))
    family = np.repeat(np.where(size <= _FEW, np.arange(len(size)), -1 - np.arange(len(size))), size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(_FEW, n)):
        i = np.flatnonzero((family[step:] == family[: n - step]) & (family[step:] >= 0))
        a.append(i)
        b.append(i + step)
    a, b = np.concatenate(a), np.concatenate(b)
    linked_ = near(a, b)
    a, b = a[linked_], b[linked_]
    while len(a):
        before = root.copy()
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        if (before == root).all():
            break
    return root


def similar_pairs(items: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets a[i] and b[i] are similar: the elements of the smaller one are looked up in the other."""
    size = np.diff(begin)
    near = (size[a] > 0) & (size[b] > 0) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
    some = np.flatnonzero(near)
    if not len(some):
        return near
    values, rank = np.unique(items, return_inverse=True)
    slot = np.sort(np.repeat(np.arange(len(size)), size) * len(values) + rank.reshape(-1))
    total = np.cumsum(np.minimum(size[a[some]], size[b[some]]))
    done = 0
    while done < len(some):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 21), "right")))
        part = some[done:end]
        small = np.where(size[a[part]] <= size[b[part]], a[part], b[part])
        n = size[small]
        wanted = np.repeat((a[part] + b[part] - small) * len(values), n) + rank[places(begin[small], n)]
        found = slot[np.minimum(np.searchsorted(slot, wanted), len(slot) - 1)] == wanted
        inter = np.add.reduceat(found, bounds(n)[:-1], dtype=np.int64)
        near[part] = 100 * inter >= percent * (size[a[part]] + size[b[part]] - inter)
        done = end
    return near


def linked(items: np.ndarray, begin: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets ``items[begin[i]:begin[i + 1]]`` of distinct hashes are similar enough; empty sets are like nothing."""
    size = np.diff(begin)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    edge = np.concatenate([[True], items[1:] != items[:-1]]) if len(items) else np.zeros(0, bool)
    number = np.cumsum(edge) - 1
    common = np.bincount(number)[number] > 1 if len(items) else edge
    owner, number = owner[common], number[common]
    number = np.unique(number, return_inverse=True)[1].reshape(-1)
    both = np.zeros((n, n), np.float32)
    step = 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(number, [low, low + step])
        has = np.zeros((n, min(step, int(number[b - 1]) + 1 - low)), np.float32)
        has[owner[a:b], number[a:b] - low] = 1
        both += has @ has.T
    inter = both.astype(np.int64)
    return (inter > 0) & (100 * inter >= percent * (size[:, None] + size[None, :] - inter))
