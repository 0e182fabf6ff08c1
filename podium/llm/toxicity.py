"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import col, documents, slices, unused
from .textvec import NOT_ALNUM, window_hashes, words

#: Words, pairs, and pairs with one word left out.
_WINDOWS = ((0,), (0, 1), (0, 2))


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, text number) of all words, word pairs and skip-pairs of the texts."""
    h, text = words(column, NOT_ALNUM)
    found = [window_hashes(h, text, steps, salt) for salt, steps in enumerate(_WINDOWS, 11)]
    return np.concatenate([x >> np.uint64(64 - bits) for x, _ in found]).astype(np.int64), np.concatenate([t for _, t in found])


def per_text(numbers: np.ndarray, text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, ordered by text."""
    both = np.unique((text << bits) | numbers)
    return both & ((1 << bits) - 1), both >> bits


class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)); L1 leaves most weights at zero."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the intercept
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, sample_rows: int = 16_384, shards: int = 1, epochs: int = 4,
          alpha: float = 1.0, beta: float = 0.1, l1: float = 6.0, l2: float = 0.1) -> DataFrame:
    """Sparse weights (feature, weight) from labelled documents; feature 2^bits is the intercept.

    ``docs``: doc_id, text. ``labels``: doc_id, label (0 or 1), one row per id. At most about ``sample_rows`` labelled documents, picked by a hash of
    the id, are learnt from; that is the bound on the learner's input and memory. With more ``shards`` that many learners share them and their
    weights are averaged. An id that several rows have counts once.
    """
    labelled = labels.count()
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, sample_rows / max(1, labelled))
    picked = labels.filter(key < int(share * (1 << 40)))
    # Bounded by sample_rows rows of two numbers, so small enough for every task.
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards))).withColumn("order", F.xxhash64("doc_id", F.lit(9)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in slices(batches, byte_bound=1 << 20):
            shard, label = batch["shard"].to_pylist(), batch["label"].to_pylist()
            numbers, text = per_text(*features(batch["text"], bits), bits)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for i, (s, y) in enumerate(zip(shard, label)):
                held.setdefault(s, []).append((np.append(numbers[cut[i] : cut[i + 1]], 1 << bits).astype(np.int32), y))
        for rows in held.values():
            model = Ftrl(bits, alpha, beta, l1, l2)
            for _ in range(epochs):
                for at, y in rows:
                    model.learn(at, y)
            every = model.weights(np.arange((1 << bits) + 1))
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_pydict({"feature": at, "weight": every[at]})

    parts = sample.repartition(shards, "shard").sortWithinPartitions("shard", "order", "doc_id").select("shard", "label", "text").mapInArrow(
        fit, "feature bigint, weight double")
    return parts.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, bits: int = 20, text_col: str = "text", carry: Sequence[str] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns of ``carry`` and the score (0 to 1) of every document's whole text, with weights of at most 2^bits + 1 features."""
    table = weights.toPandas()  # bounded by the feature space
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[table["feature"].to_numpy(np.int64)] = table["weight"]
    at = np.flatnonzero(dense)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), dense[at]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[sent.value[0]] = sent.value[1]
        for batch in slices(batches, byte_bound=1 << 20):
            *kept, text = batch.columns
            numbers, owner = features(text, bits)
            live = np.flatnonzero(w[numbers])  # most are zero: only the others need to be made distinct
            numbers, owner = per_text(numbers[live], owner[live], bits)
            total = np.bincount(owner, weights=w[numbers], minlength=batch.num_rows) + float(w[1 << bits])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*carry, into])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(into, T.DoubleType())])
    return docs.select(*map(col, carry), F.coalesce(col(text_col), F.lit("")).alias(unused(docs, "text"))).mapInArrow(rows, schema)


def held_out(doc_id) -> F.Column:
    """One document in five takes no part in learning. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def label_rows(labels: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the ids that may be learnt from; of several labels the most frequent one, 0 on a tie."""
    ids = labels.select(col(id_col).cast("bigint").alias("doc_id"), col(name).cast("double").alias("_y")).filter("doc_id IS NOT NULL AND _y IS NOT NULL")
    return ids.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("_y") > 0.5).cast("int").alias("label"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are never read.

    Null text is empty and scores the intercept. Null ids are scored, never learnt from. Repeated rows get equal
    scores. Texts of any length are read whole, a text in one task. Without labels every score is 0.5. An empty table gives no
    rows. Other columns are ignored.
    """
    tidy = documents(docs, id_col, text_col)
    weights = train(tidy, label_rows(labels, label_col), **options)
    scored = score(tidy, weights, options.get("bits", 20))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``docs`` without the documents predicted toxic, other columns as they are. One pass after learning, no join.

    Null texts score the intercept; repeated rows go or stay together; an empty table stays empty; texts of any length are read
    whole; columns may have any names.
    """
    into = unused(docs, "toxicity")
    weights = train(documents(docs, id_col, text_col), label_rows(labels, label_col), **options)
    scored = score(docs, weights, options.get("bits", 20), text_col, docs.columns, into)
    return scored.filter(F.col(into) < 0.5).drop(into)
