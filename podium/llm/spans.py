"""Spans of many texts gathered at once: places of all their bytes, spans as strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every span, one span after the other."""
    total = np.cumsum(sizes)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - total + sizes, sizes)


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive spans begins, and the end."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings over the bytes ``body`` (UTF-8 as they are in the texts they come from)."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body.tobytes())]).cast(pa.string())


def spaced(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words, each followed by one space, where each begins and the end)."""
    sizes = ends - starts + 1
    offsets = bounds(sizes)
    at = places(starts, sizes)
    body = flat[np.minimum(at, len(flat) - 1)] if len(at) else np.zeros(0, np.uint8)
    body[offsets[1:] - 1] = 32
    return body, offsets
