"""Array helpers used inside tasks: slices of texts, hashes of spans, runs of indexes."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa


def trimmed(batches):
    """The batches; when they end, freed memory goes back to the machine, as a worker waits for its next task, and a
    JVM beside it works on."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library's own call, where it has one
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts, limit: int):
    """(first row, past-the-last row, UTF-8 of the texts) of about ``limit`` bytes; a longer text stands alone."""
    data = [t if isinstance(t, bytes) else t.encode("utf-8") if t else b"" for t in texts]
    at = 0
    while at < len(data):
        to, size = at + 1, len(data[at])
        while to < len(data) and size + len(data[to]) <= limit:
            size += len(data[to])
            to += 1
        yield at, to, data[at:to]
        at = to


def span_hash(values: np.ndarray, starts, ends, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each span of ``values``, from one running sum; ``base`` is odd."""
    n = len(values)
    powers = np.cumprod(np.full(n, base, np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers)])
    # the inverse power moves every span to the origin (an odd base has an inverse)
    back = np.cumprod(np.full(n, pow(int(base), -1, 2**64), np.uint64))
    return mix64((run[ends] - run[starts]) * back[np.minimum(starts, max(n - 1, 0))]) if n else np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, end to end."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def runs(flags: np.ndarray):
    """(starts, ends) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
