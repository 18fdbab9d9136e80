"""Words of a whole Arrow batch at once: byte positions and 64-bit hashes as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: Text bytes that are worked on at once; longer single documents are worked on alone.
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def releasing(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over batches; when it ends, what it freed goes back to the machine, as workers live on for later tasks."""

    @wraps(run)
    def whole(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``most`` bytes of text at most, at least one row each."""
    _, begins = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(begins, begins[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def word_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word; words never reach over the end of a text."""
    inside = ~SPACE[data]
    edges = begins[:-1][begins[:-1] < begins[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[begins[1:][begins[:-1] < begins[1:]] - 1] = inside[begins[1:][begins[:-1] < begins[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(begins, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (none of them empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    powers = _powers(1 << int(sizes.max()).bit_length())
    terms = _BYTE_VALUES[data[within + np.repeat(starts, sizes)]] * powers[within]
    return mixed(np.add.reduceat(terms, at) + sizes.astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the texts, A-Z in lower case."""
    data, begins = utf8(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, begins)
    return span_hashes(data, starts, ends), rows


def ascii_lower(column):
    """A-Z in lower case, every other character as it is; null becomes empty."""
    return F.translate(
        F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def map_slices(df: DataFrame, column: str, function, schema: str) -> DataFrame:
    """``function(record_batch)`` -> record batches, over parts of bounded text size."""

    @releasing
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = function(part)
                yield from (out,) if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)
