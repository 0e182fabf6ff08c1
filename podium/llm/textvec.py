"""Array operations over the bytes of many texts at once: words as 64-bit hashes, classes of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 of eight bytes, read as a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Blanks between words of the shingle operators.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(9, 14)]] = True
#: ASCII other than letters and digits: separators where punctuation carries nothing.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of the result may be used."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them, one more than there are texts). The column has no nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def word_spans(flat: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; a text's border ends a word."""
    inside = np.zeros(len(flat) + 1, bool)
    inside[:-1] = ~separators[flat]
    border = np.zeros(len(flat) + 1, bool)
    border[offsets] = True
    before = np.zeros(len(flat) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border))
    ends = np.flatnonzero(before & (~inside | border))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap.

    The sum of its mixed stretches of eight bytes, each with its number in the span: no word is made of others by adding up.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        padded = np.zeros(b - a + 8, np.uint8)
        padded[: b - a] = _LOWER[flat[a:b]] if lower else flat[a:b]
        size = ends[i:j] - starts[i:j]
        pieces = (size + 7) >> 3
        first = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        at = np.repeat(starts[i:j] - a, pieces) + 8 * number
        value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(np.uint64)[:, 0]
        value &= _FIRST[np.minimum(np.repeat(size, pieces) - 8 * number, 8)]
        sums = np.concatenate([[_U(0)], np.cumsum(mix(value + (number.astype(np.uint64) + _U(1)) * _BASE), dtype=np.uint64)])
        out[i:j] = sums[first + pieces] - sums[first]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _BASE)


def words(column: pa.Array, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts, A-Z lowered, in order."""
    flat, offsets = text_bytes(column)
    starts, ends, text = word_spans(flat, offsets, separators)
    return span_hashes(flat, starts, ends), text


def window_hashes(h: np.ndarray, text: np.ndarray, steps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at ``steps`` from each word, where all lie in one text: (hash, text number)."""
    n = len(h) - steps[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = np.random.default_rng(salt).integers(1, 1 << 63, len(steps), dtype=np.uint64) * _U(2) + _U(1)
    total = np.zeros(n, np.uint64)
    for step, factor in zip(steps, factors):
        total += h[step : step + n] * factor
    same = text[:n] == text[steps[-1] : steps[-1] + n]
    return mix(total[same]), text[:n][same]
