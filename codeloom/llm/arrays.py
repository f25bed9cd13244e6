"""Numpy helpers over batches of texts: words, range digests and minimizers.

All work on one flat byte buffer per batch.  A batch is cut into parts of about a megabyte, so a task's
memory follows the longest single text and not the batch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space bytes that end a word: 0x09-0x0D and 0x20.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20260101).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
PART = 1 << 20


def slices(column: pa.Array, size: int = PART) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive texts of about ``size`` bytes, one text at least, with their places; null texts are empty."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(length, dtype=np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
        yield a, b, [t or b"" for t in column.slice(a, b - a).to_pylist()]
        a = b


def few_rows(batches, n: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``n`` rows, for work that turns rows into Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, n):
            yield batch.slice(a, n)


def powers(kind: str, n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64, or its inverses; kept by the worker and grown when needed."""
    if len(_POWERS[kind]) < n:
        base = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _POWERS[kind] = np.multiply.accumulate(base)
    return _POWERS[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Ranges:
    """Polynomial digests of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers("up", len(values)), out=self.sums[1:])
        self.down = powers("down", len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text; start and end of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts, starts + lengths


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Ranges(_BYTE[buf]).of(starts, ends)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window of ``width``, the first one where several are equal."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    if n < 1 << 24:
        cur, span = (values & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= width:
            cur, span = np.minimum(cur[:-span], cur[span:]), span * 2
        rest = n - width + 1
        best = np.minimum(cur[:rest], cur[width - span : width - span + rest])
        return (best & np.uint64(0xFFFFFF)).astype(np.int64)
    high, at, span = values >> np.uint64(24), np.arange(n), 1

    def smaller(i, j):
        return np.where(high[j] < high[i], j, i)

    while span * 2 <= width:
        at, span = smaller(at[:-span], at[span:]), span * 2
    rest = n - width + 1
    return smaller(at[:rest], at[width - span : width - span + rest])


def minimizers(values: np.ndarray, width: int, owner: np.ndarray) -> np.ndarray:
    """Distinct positions chosen by the windows that lie within one owner; ``owner`` is non-decreasing."""
    at = window_minima(values, width)
    if not len(at):
        return at
    at = at[owner[: len(at)] == owner[width - 1 : width - 1 + len(at)]]
    return at[np.concatenate(([True], np.diff(at) > 0))] if len(at) else at


def counts_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)
