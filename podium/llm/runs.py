"""Periodic runs of words: candidates on harmonic grids, extended by a recompression grammar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, slices
from .recompression import Grammar
from .spans import bounds, places, spaced, strings
from .textvec import BLANK, text_bytes, word_spans

_POINTS = 1 << 20  # candidates handled at a time
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def grid(count: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequence, place, period) of the candidates in sequences of ``count`` items, many at a time.

    A run of period p is at least max(least, times * p) long, so the places that equal the one p further on are at least that
    less p in a row: a multiple of this step lies among them. Steps grow with p, so n items have about n * log(n) / 2 candidates.
    """
    periods = np.where(count >= least, count // times, 0)
    owner = np.repeat(np.arange(len(count)), periods)
    period = places(np.ones(len(count), np.int64), periods)
    step = np.maximum(least, times * period) - period
    points = (count[owner] - 1 - period) // step + 1
    done, total = 0, np.cumsum(points)
    while done < len(points):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _POINTS, "right")))
        n = points[done:end]
        yield np.repeat(owner[done:end], n), places(np.zeros(len(n), np.int64), n) * np.repeat(step[done:end], n), np.repeat(period[done:end], n)
        done = end


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows in order, each once."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def find_runs(symbols: np.ndarray, count: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, smallest period) of all runs, by sequence, start and period. ``symbols`` are numbers from 0."""
    first = bounds(count)
    grammar, back, found = None, None, []
    for owner, at, period in grid(count, least, times):
        here = first[owner] + at
        some = symbols[here] == symbols[here + period]
        owner, at, period = owner[some], at[some], period[some]
        if not len(owner):
            continue
        if grammar is None:
            grammar = Grammar(symbols, first)
            back = grammar.reversed()
        place = first[owner] + at + owner + 1
        right = grammar.forward(place, place + period)
        left = back.forward(len(grammar.laid) - place, len(grammar.laid) - place - period)
        length = left + right + period
        long = length >= np.maximum(least, times * period)
        found.append(_distinct(owner[long], at[long] - left[long], length[long], period[long]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    owner, start, length, period = _distinct(*map(np.concatenate, zip(*found)))
    # A stretch that repeats with p repeats with its multiples, too; the smallest one comes first.
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = owner[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words stand between blanks. A run is a stretch of words with smallest period q of at least max(``least``, ``times`` * q) words,
    ``times`` 2 or more, that cannot be extended with that period. ``collapsed`` are the words that remain, one space between
    them, when all of a run after its first q words goes.

    Words are numbered by their bytes and a slice of documents becomes one grammar. Each row is its own: nothing is shuffled,
    and copies in any number stay where they are. Null and empty texts have no words and no runs. A text of any length is
    handled whole, in one task, with memory in proportion to it. Null ids and repeated rows are rows like others; an empty table
    gives no rows. Other columns are ignored.
    """
    read = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 1 << 20):
            flat, offsets = text_bytes(batch["text"])
            starts, ends, text = word_spans(flat, offsets, BLANK)
            count = np.bincount(text, minlength=batch.num_rows)
            body = strings(flat[places(starts, ends - starts)], bounds(ends - starts))
            symbols = body.dictionary_encode().indices.to_numpy().astype(np.int64)
            owner, start, length, period = find_runs(symbols, count, least, times)
            first = bounds(count)
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, first[owner] + start + period, 1)
            np.add.at(cover, first[owner] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
            out, edge = spaced(flat, starts[kept], ends[kept])
            edge = edge[np.searchsorted(text[kept], np.arange(batch.num_rows + 1))]
            size = np.maximum(np.diff(edge) - 1, 0)
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count), lists, strings(out[places(edge[:-1], size)], bounds(size))],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    return read.mapInArrow(find, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")
