"""Arrays of words cut from the bytes of many texts: slices as strings, and words joined by single spaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges data[start:start + size] one after another, and where each of them ends."""
    end = np.cumsum(size)
    at = np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)
    return data[at], end


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a string array."""
    out, stop = _gather(data, start, end - start)
    return _array(out, stop)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> pa.Array:
    """One string for each number in count: so many of the words (byte ranges, each followed by at least
    one more byte of data), joined by single spaces."""
    out, stop = _gather(data, start, end - start + 1)
    out[stop - 1] = 32
    last = np.cumsum(count)
    closing = stop[last[count > 0] - 1] - 1
    keep = np.ones(len(out), bool)
    keep[closing] = False
    size = np.concatenate(([0], stop))[last] - np.cumsum(count > 0)
    return _array(out[keep], size)


def _array(data: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.concatenate((np.zeros(1, np.int64), end)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
