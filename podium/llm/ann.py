"""Approximate nearest neighbours by inner product with a permutation index.

Every vector is represented by its nearest pivots in order. A shard posts its vectors in one inverted file per pivot, each
posting with the pivot's place in the vector's order. A query adds up, over the files of its own nearest pivots, how well the places
agree; that sum orders the shard's vectors by footrule distance of the two orders (pivots beyond the kept ones count as one
place further). The nearest by footrule are reranked by the exact inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Stages
from .common import col, dealt_anew


def orders(x: np.ndarray, pivots: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` nearest pivots of each vector, nearest first."""
    near = -(x @ pivots.T)
    some = np.argpartition(near, keep - 1, axis=1)[:, :keep] if keep < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


class InvertedFiles:
    """Postings of one shard: for each pivot, vectors and the pivot's weight (kept places behind it, and itself)."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, keep: int) -> None:
        self.n, self.pivots, self.keep = len(x), pivots, min(keep, len(pivots))
        order = orders(x, pivots, self.keep)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.vector, place = np.divmod(by_pivot, self.keep)
        self.weight = (self.keep - place).astype(np.float64)
        self.begin = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` vectors nearest by footrule to a query with this order of pivots."""
        spans = [slice(self.begin[p], self.begin[p + 1]) for p in order.tolist()]
        agree = [np.minimum(self.weight[s], self.keep - i) for i, s in enumerate(spans)]
        # Footrule = keep * (keep + 1) - 2 * (sum of the smaller weights of common pivots).
        common = np.bincount(np.concatenate([self.vector[s] for s in spans]), np.concatenate(agree), self.n)
        return np.argpartition(-common, count - 1)[:count] if count < self.n else np.arange(self.n)


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, pivots: int = 1024, keep: int = 128, rerank_share: float = 0.04, rerank_per_k: int = 10,
           shard_rows: int = 8192, query_values: int = 1 << 21, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``query_every``.

    Equal vectors are searched once and stand with their k + 1 smallest ids, all that can appear in a result; ties go to the smaller
    id. ``pivots`` distinct vectors with the smallest hashes are the pivots, a bounded sample. Shards of about ``shard_rows``
    vectors meet blocks of queries of about ``query_values`` components, and build their inverted files once per block. Each shard
    reranks ``rerank_share`` of its vectors and ``rerank_per_k`` times ``k`` more for every query.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Shorter vectors
    count as filled up with zeros. Repeated rows (same id and vector) count once; an id with several vectors is as many
    rows, none of which is a neighbour of another. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "ann")
    v = F.col("v")
    tidy = vectors.select(col(id_col).cast("bigint").alias("vec_id"), col(vector_col).cast("array<double>").alias("v")).filter(
        v.isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    tidy = tidy.distinct()
    dim = tidy.agg(F.max(F.size("v"))).first()[0] or 1
    tidy = stages.write(tidy.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))), "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = tidy.withColumn("_n", place).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    rows = stages.write(rows.withColumn("key", F.xxhash64("v")), "distinct")
    asked = tidy.filter(F.col("vec_id") % query_every == 0)
    asked_rows = stages.write(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "queries")
    n, n_asked = rows.count(), asked_rows.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_asked * dim / query_values))
    sample = np.array([r["v"] for r in rows.orderBy("key", "v").select("v").limit(pivots).collect()]).reshape(-1, dim)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def meet(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = {"q": [], "ids": [], "scores": []}
        if shard.num_rows and block.num_rows:
            x, ids = matrix(shard["v"]), shard["ids"].to_pylist()
            files = InvertedFiles(x, sample, keep)
            count = min(len(x), math.ceil(rerank_share * len(x)) + rerank_per_k * k)
            numbers, at = block["q"].to_pylist(), 0
            for part in block.select(["v"]).to_batches(max_chunksize=1024):
                q = matrix(pa.chunked_array([part["v"]]))
                for row, order in zip(q, orders(q, sample, files.keep)):
                    near = files.nearest(order, count)
                    score = (x[near] * row).sum(1)
                    bound = -np.partition(-score, k)[k] if len(near) > k + 1 else -np.inf
                    some = score >= bound
                    found = sorted((-s, i) for s, j in zip(score[some].tolist(), near[some].tolist()) for i in ids[j])[: k + 1]
                    out["q"].append(numbers[at])
                    out["ids"].append([i for _, i in found])
                    out["scores"].append([-s for s, _ in found])
                    at += 1
        return pa.table({"q": pa.array(out["q"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64())), "scores": pa.array(out["scores"], pa.list_(pa.float64()))})

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("v", "ids", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    right = asked_rows.select("v", "q", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "q bigint, ids array<bigint>, scores array<double>")
    pairs = met.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("q", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = pairs.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("found"))
    # The smaller side's size is not known to the planner, so it must not choose to broadcast it.
    named = asked.select(F.col("vec_id").alias("query_id"), "v").hint("merge").join(asked_rows, "v").select("query_id", "q")
    joined = named.hint("merge").join(dealt_anew(best, "q"), "q")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    top = joined.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("p", "f"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.m")).alias("score"))
