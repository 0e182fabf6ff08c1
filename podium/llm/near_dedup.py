"""Near-duplicate documents: MinHash over word shingles, a multi-index Hamming join, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Stages
from .common import col, dealt_anew, row_key, slices, unused
from .components import components
from .hamming import Index, confirm, suspects
from .textvec import mix, window_hashes, words

_WORDS = 5
#: At similarity 0.75 a pair shares a key with probability 1 - 6e-6; the join is certain up to 23 of 60 symbols.
INDEX = Index(chunks=12, width=5, errors=1, differ=33)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, where each text's begin and the end)."""
    h, text = words(column)
    long, of_long = window_hashes(h, text, tuple(range(_WORDS)), 41)
    count = np.bincount(text, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < _WORDS))
    extra = []
    first = np.searchsorted(text, short)
    for a, n in zip(first.tolist(), count[short].tolist()):
        value = np.array([n], np.uint64)
        for i in range(a, a + n):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
        extra.append(value[0])
    order = None
    if len(short):
        long, of_long = np.concatenate([long, np.array(extra, np.uint64)]), np.concatenate([of_long, short])
        order = np.argsort(of_long, kind="stable")
        long, of_long = long[order], of_long[order]
    cut = np.searchsorted(of_long, np.arange(len(column) + 1))
    sets = [np.unique(long[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return np.concatenate(sets or [long]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, index: Index = INDEX) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and k1, k2, the key of the row.

    Sets of distinct shingles of five words; a shorter text is one shingle, a text without words has none and is linked
    with nothing. Documents with equal sets are one class. Classes whose signatures meet in the Hamming join form families;
    within a family all members' full sets are compared, and linked classes are joined to components.
    ``component_id`` is the smallest doc_id of the component; ``kept`` says that it is the document's own.

    Null text is empty. Null ids are members like others, but never a component's id unless it has no other
    (then it is null and such rows are kept). Repeated rows are one class. Texts of any length are read whole, a text in one task.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "near-dedup")
    text = F.coalesce(col(text_col), F.lit(""))
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), *row_key(id_col, text_col), text.alias("text"))
    schema = "doc_id bigint, row bigint, k1 bigint, k2 bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, sig binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1 << 20):
            items, cut = shingles(batch["text"])
            size = np.diff(cut)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(items), mix(items ^ np.uint64(0x5DEECE66D1234567)))]
            prints = [(s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums]
            some = np.flatnonzero(size)
            signatures = index.signatures(items, np.append(cut[some], cut[-1]))
            keys: list = [None] * len(size)
            sigs: list = [None] * len(size)
            for i, k, s in zip(some.tolist(), index.keys(signatures), signatures.astype(np.uint8)):
                keys[i], sigs[i] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "row", "k1", "k2")), pa.array(size), *map(pa.array, prints),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                                             names=["doc_id", "row", "k1", "k2", "n", "f1", "f2", "keys", "sig"])

    signed = stages.write(read.mapInArrow(sign, schema), "signed")
    same = ["n", "f1", "f2"]
    classes = signed.filter("n > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = stages.write(classes, "classes")
    heads = signed.select(F.col("row").alias("node"), "k1", "k2", "keys", "sig").join(classes.select("node"), "node")
    heads = stages.write(heads, "heads")
    pairs = stages.write(suspects(heads.select("node", "keys", "sig"), index), "suspects")
    families = components(pairs, "near-dedup-families").select("node", F.col("root").alias("family"))
    wanted = stages.write(families.join(heads.select("node", "k1", "k2"), "node"), "members")
    # Fully repeated rows match together; any of them will do, as their texts are equal.
    members = read.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"]).groupBy("node", "family").agg(F.min("text").alias("text"))
    links = stages.write(confirm(members, shingles, percent), "links")
    stages.drop("heads", "suspects", "members")
    roots = components(links, "near-dedup-components")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stages.write(named, "named")
    stages.drop("links", "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(dealt_anew(least, "root"), "root").select(*same, "component_id")
    out = signed.select("doc_id", *same, "k1", "k2").join(named, same, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "k1", "k2")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, other columns as they are; of repeated rows one stays.

    Rows without text, and those of a component that has null ids only, stay, one of each id and text. An empty table stays empty;
    texts of any length are read whole; columns may have any names.
    """
    key = unused(docs, "key")
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.struct("k1", "k2").alias(key + "_"))
    rows = docs.withColumn(key, F.struct(*row_key(id_col, text_col)))
    rows = rows.join(kept.hint("merge"), F.col(key) == F.col(key + "_"), "left_semi")
    return rows.dropDuplicates([key]).select(*map(col, docs.columns))
