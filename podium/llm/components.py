"""Connected components of a graph of long ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Stages
from .common import dealt_anew


_HELD = 1 << 20  # edges that a task contracts together


def _stars(edges: DataFrame) -> DataFrame:
    """Edges of the same components: what is connected by the edges that a task holds at a time becomes a star around its smallest id."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _HELD:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
        node, at = np.unique(np.append(a, b), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(node))
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while ((up := root[root]) != root).any():
                root = up
        some = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"])

    return edges.mapInArrow(contract, "a bigint, b bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest id around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them. Edges lead from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(dealt_anew(least, "a"), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge, ``root`` the smallest id of its component.

    ``edges``: a long, b long; directions, repeats and loops do not matter. Each round is a staged table; the former
    one goes. Tasks contract what they hold before the rounds, a bounded number of edges at a time; the rounds connect the rest, until so
    few edges are left that one task may hold them.
    Minima are aggregated before the shuffle, and the edges of a node with very many of them may be split in the joins.
    """
    stages = Stages(edges.sparkSession, name)
    state = stages.write(_stars(_stars(edges.filter("a != b").select("a", "b")).distinct()), "round-0")
    seen, n = None, 0
    while True:
        # Stars are reached when nothing changes any more; sums of hashes stand for the whole edge set.
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        few = mark[0] <= _HELD  # one task ends what it may hold
        seen, n = mark, n + 1
        state = stages.write(_stars(state.coalesce(1)) if few else _small_star(_large_star(state)), f"round-{n}")
        stages.drop(f"round-{n - 1}")
        if few:
            break
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
