"""Source divergence audit: how far the term distributions of sources lie from each other and from their language's.

Terms are counted in arrays: short ones are packed into one or two 64-bit words, bucketed by length so that a bucket needs as
few radix passes as its terms have pairs of bytes, sorted and run-counted; long ones are sorted as bytes in buckets of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import first_per_group
from ..session import Stages
from .common import col, slices
from .hamming import _edges_of, _groups
from .spans import places, strings
from .textvec import _LOWER, text_bytes, word_spans

#: ASCII other than letters: what stands between terms.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
UNIT = 1_000_000_000  # shares are counted in parts of this
_SIDE, _SHARD = 64, 2048  # about so many sources on a side of a matrix, kept terms in it


def _radix(order: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """``order``, stably sorted by 16-bit digits (numpy sorts these by radix)."""
    return order[np.argsort(digits[order], kind="stable")]


def packed(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """(terms, words) big-endian 64-bit words of terms of at most 8 * ``words`` bytes, zero beyond their end."""
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(8 * words, np.uint8)]), 8 * words)
    raw = wide[starts].copy()
    raw[np.arange(8 * words) >= sizes[:, None]] = 0
    return raw.view(">u8").astype(np.uint64)


def runs_short(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new term or group begins in it) for terms of at most 2 * ``digits`` bytes; equal ones stay in order."""
    words = packed(flat, starts, sizes, -(-digits // 4))
    order = np.arange(len(starts))
    for d in range(digits - 1, -1, -1):
        order = _radix(order, (words[:, d // 4] >> np.uint64(48 - 16 * (d % 4))).astype(np.uint16))
    order = _radix(order, group)
    new = np.ones(len(order), bool)
    laid, of = words[order], group[order]
    new[1:] = (laid[1:] != laid[:-1]).any(1) | (of[1:] != of[:-1])
    return order, new


def runs_long(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for terms of similar length of more than 16 bytes, sorted as bytes. No term holds a zero byte."""
    width = int(sizes.max())
    raw = np.zeros(len(starts) * width, np.uint8)
    raw[places(np.arange(len(starts)) * width, sizes)] = flat[places(starts, sizes)]
    terms = raw.view(f"S{width}")
    order = _radix(np.argsort(terms, kind="stable"), group)
    new = np.ones(len(order), bool)
    laid, of = terms[order], group[order]
    new[1:] = (laid[1:] != laid[:-1]) | (of[1:] != of[:-1])
    return order, new


def count_terms(column: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents with it) of every term of every group of texts; groups are numbered below 65536."""
    flat, offsets = text_bytes(column)
    flat = _LOWER[flat]
    starts, ends, text = word_spans(flat, offsets, NOT_LETTER)
    sizes, out = ends - starts, []
    # Buckets: 1 to 2, 3 to 4, ... 16 bytes by their number of digits; beyond, by powers of two.
    bucket = np.where(sizes <= 16, (sizes + 1) // 2, 16 + np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for b in np.unique(bucket).tolist():
        some = np.flatnonzero(bucket == b)
        of = group[text[some]]
        order, new = runs_short(flat, starts[some], sizes[some], of, b) if b <= 8 else runs_long(flat, starts[some], sizes[some], of)
        first = np.flatnonzero(new)
        doc = text[some][order]
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        out.append((of[order[first]], some[order[first]], np.diff(np.append(first, len(order))), np.add.reduceat(fresh, first)))
    if not out:
        return np.zeros(0, np.uint16), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, term, n, docs = (np.concatenate(x) for x in zip(*out))
    offsets = np.concatenate([[0], np.cumsum(sizes[term])])
    return of, strings(flat[places(starts[term], sizes[term])], offsets), n, docs


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df) over all documents, summed up in each task first; a row with null term for every (lang, source)."""
    read = docs.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32768, 8 << 20):
            pair = pa.StructArray.from_arrays([batch["lang"], batch["source"]], names=["lang", "source"])
            keys, group = np.unique(np.array([f"{len(x['lang'])} {x['lang']}{x['source']}" for x in pair.to_pylist()], object), return_index=True, return_inverse=True)[1:]
            of, term, n, df = count_terms(batch["text"], group.astype(np.uint16))
            marks = np.arange(len(keys))
            at = pa.array(keys[np.concatenate([of, marks]).astype(np.int64)])
            none = np.zeros(len(marks), np.int64)
            yield pa.RecordBatch.from_arrays([batch["lang"].take(at), batch["source"].take(at), pa.concat_arrays([term, pa.nulls(len(marks), pa.string())]),
                                              pa.array(np.concatenate([n, none])), pa.array(np.concatenate([df, none]).astype(np.int64))],
                                             names=["lang", "source", "term", "n", "df"])

    counted = read.mapInArrow(count, "lang string, source string, term string, n bigint, df bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), null where nothing is kept; in decimals, as counts times UNIT may pass 64 bits."""
    two = F.lit(2).cast("decimal(1,0)")
    n, total, kept = (c.cast("decimal(19,0)") for c in (n, total, kept))
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + two), F.nullif(total + two * kept, F.lit(0))) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); shares are at most UNIT + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per matrix (lang, block i, block j, shard): sums of distances of every two of its sources over the terms of its rows.

    Rows of a matrix are in order of source, so its two sources of a block are named in the same order in every shard.
    """
    order = ["lang", "_i", "_j", "_shard"]
    for table in _groups(batches, order):
        cut = _edges_of([table[c].to_numpy() for c in order])
        for at, end in zip(cut[:-1].tolist(), cut[1:].tolist()):
            rows = table.slice(at, end - at)
            source = rows["source"].combine_chunks().dictionary_encode()
            names, of = source.dictionary, source.indices.to_numpy()
            entry = rows["term"].is_valid().to_numpy()
            term = rows["term"].filter(pa.array(entry)).combine_chunks().dictionary_encode()
            width, p = len(term.dictionary), rows["p"].to_numpy()
            base, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            base[of[~entry]] = p[~entry]
            side[of] = rows["_b"].to_numpy()
            shares = np.repeat(base[:, None], width, 1)
            shares[of[entry], term.indices.to_numpy()] = p[entry]
            i, j = rows["_i"][0].as_py(), rows["_j"][0].as_py()
            a, b, total = [], [], []
            for s in np.flatnonzero(side == i).tolist():
                others = np.flatnonzero((side == j) & ((i != j) | (np.arange(len(names)) > s)))
                sums = np.zeros(len(others), np.int64)
                for low in range(0, width, 1024):
                    mine, theirs = shares[s, low : low + 1024], shares[others, low : low + 1024]
                    sums += ((mine - theirs) ** 2 // (mine + theirs)).sum(1)
                a.append(np.full(len(others), s))
                b.append(others)
                total.append(sums)
            if not a:
                continue
            a, b, total = map(np.concatenate, (a, b, total))
            yield pa.RecordBatch.from_arrays([pa.array([rows["lang"][0].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)),
                                              pa.array(np.full(len(a), width)), pa.array(total)], names=["lang", "source", "item", "terms", "value"])


def source_divergence(docs: DataFrame, least_documents: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): what is between a source and every other one of its language, and its own terms.

    Terms are stretches of letters (all characters beyond ASCII are letters), A-Z lowered. A language keeps the V terms that stand
    in at least ``least_documents`` of its documents. A source's share p of a kept term is 1 + floor(10**9 * (n + 2) / (N + 2 * V)),
    N all its occurrences of kept terms; the language's q likewise. A distance of shares is floor((p - q)**2 / (p + q)).

    Part ``pair``: item is another source, value the distances summed over all kept terms. Part ``term``: item is a kept term that
    the source has with p > q, value the distance; the ``top`` first. Ranks are from 1, larger values first, ties by the UTF-8 of item.

    Sources meet in matrices of about 64 x 64 sources and about 2048 terms; terms that none of a matrix's sources has are added at
    the end as their number times the distance of both bases. Pairs of sources of one language are what the result lists, so they
    are the only pairs that are made. Arithmetic is exact: counts and totals up to 10**18.

    Null text, language and source are ''. A source without any term is there, with pairs only. Repeated rows count each. A text of
    any length is counted whole, in one task. A language with one source has no pairs, one without kept terms has value 0 in all
    pairs. An empty table gives no rows. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession, "divergence")
    counts = stages.write(term_counts(docs, text_col, lang_col, source_col), "counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df"))
    kept = stages.write(kept.filter(F.col("df") >= least_documents).drop("df"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    rows = stages.write(counts.filter("term IS NOT NULL").drop("df").join(kept.hint("merge"), ["lang", "term"]), "rows")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / _SIDE).alias("_sides")), "lang")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total")),
                           F.pmod(F.xxhash64("source"), F.col("_sides")).cast("int").alias("_b"), F.col("_sides").cast("int").alias("_sides"))
    groups = stages.write(groups.withColumn("base", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(1))), "groups")
    stages.drop("counts", "kept")

    rows = rows.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    q = share(F.col("all"), F.col("lang_total"), F.col("kept"))
    shards = F.greatest(F.ceil(F.col("kept") / _SHARD), F.lit(1)).cast("int")
    terms = rows.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = first_per_group(terms, ["lang", "source"], [F.desc("value"), F.asc("item")], top)

    entries = rows.select("lang", "source", "_b", "_sides", "term", "p", F.pmod(F.xxhash64("term"), shards).cast("int").alias("_shard"))
    bases = groups.select("lang", "source", "_b", "_sides", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("_shard"))
    cells = entries.unionByName(bases).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)))
    cells = cells.select("lang", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_shard", "_b", "source", "term", "p")
    keys = ["lang", "_i", "_j", "_shard"]
    sums = cells.repartition(*keys).sortWithinPartitions(*keys, "source").mapInArrow(_between, "lang string, source string, item string, terms bigint, value bigint")
    sums = stages.write(sums.groupBy("lang", "source", "item").agg(F.sum("terms").alias("terms"), F.sum("value").alias("value")), "sums")
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "terms", "value"))
    mine = groups.select("lang", "source", "kept", F.col("base").alias("_p"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("_q"))
    rest = (F.col("kept") - F.col("terms")) * distance(F.col("_p"), F.col("_q"))
    pairs = both.join(mine, ["lang", "source"]).join(other, ["lang", "item"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value"))
    # A source has one row per other source, a small part of all pairs, however many sources there are.
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", place).select(*names).unionByName(terms.withColumn("rank", F.col("rank").cast("int")).select(*names))
