"""Vectorised work on batches of texts as UTF-8 bytes (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # work on a slice of texts holds up to 70 bytes for each of them
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        made = []
        for base in (_P, _P_INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers


class Sequence:
    """Hashes of any slice of a symbol sequence, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, symbols: np.ndarray):
        up, self._down = _pow(len(symbols) + 1)
        self._sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each slice ``[start, end)``; equal slices have equal hashes."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` symbols."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n])


class Chunk:
    """Some texts of a batch as one buffer: text ``i`` is ``data[starts[i]:ends[i]]``, then one ``\\n``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        lengths = np.diff(offsets)
        self.starts = offsets[:-1] - offsets[0] + np.arange(self.n)
        self.ends = self.starts + lengths
        self.data = np.insert(data[offsets[0]:offsets[-1]], self.ends - np.arange(self.n), 10) if self.n else data[:0]

    @property
    def bytes(self) -> Sequence:
        if not hasattr(self, "_bytes"):
            self._bytes = Sequence(_TABLE[self.data])
        return self._bytes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of bytes that are not white space, and the words' count per text."""
        gap = np.concatenate(([True], SPACE[self.data]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edges[::2], edges[1::2]
        return start, end, np.searchsorted(start, self.ends) - np.searchsorted(start, self.starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every line, and the lines' count per text."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        return start, end, np.searchsorted(end, self.ends, "right") - np.searchsorted(end, self.starts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per byte."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.ends] - sums[self.starts]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Cut batches into slices of about ``limit`` bytes of text (one text at least), so that a
    task's memory follows the longest text and not the rows in a batch."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), Chunk(data, offsets[at:to + 1])
            at = to
    pa.default_memory_pool().release_unused()  # the worker stays for later tasks


def column_batches(columns: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
    """The arrays an Arrow function is handed, as batches with the one column ``text``."""
    for column in columns:
        yield pa.RecordBatch.from_arrays([column], names=["text"])


def ranks_of_equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: how many equal ones stand before it, and how many equal ones there are."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate((at, [len(k)])))
    rank, count = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    rank[order] = np.arange(len(k)) - np.repeat(at, size)
    count[order] = np.repeat(size, size)
    return rank, count


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive groups of the given sizes."""
    sums = np.concatenate(([0], np.cumsum(values)))
    at = np.concatenate(([0], np.cumsum(counts)))
    return sums[at[1:]] - sums[at[:-1]]
