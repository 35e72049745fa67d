"""Vectorised word helpers over Arrow string columns.

A batch of texts is one UTF-8 byte buffer with row offsets. Words, their
64-bit hashes and shingle hashes are computed for the whole buffer with numpy,
so no Python object is made per word. Separators are single bytes below 0x80
and therefore never split a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
BATCH_ROWS = 2_000  # rows of a batch that travels between Spark and a Python worker
# Odd multiplier of the polynomial byte hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + 1), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows: texts are long, and a
    batch is held by the JVM and by the worker at once. The limit is a setting of the
    session; a smaller one is left as it is."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text, so the
    arrays made from one run stay small; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length + 1, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind, count=n + column.offset + 1)[column.offset:].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of texts: byte ``start`` and ``end``, ``row`` of each,
    and ``first`` (rows + 1), the index of each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = inside[cuts]
        ends = np.zeros(len(data) + 1, dtype=bool)
        ends[1:] = inside
        ends[1:-1] &= ~inside[1:]
        after = offsets[1:-1]
        after = after[after > 0]
        ends[after] = inside[after - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes (optionally with A-Z lower-cased)."""
        return span_hashes(ASCII_LOWER[self.data] if lower else self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-overlapping ascending byte spans, in blocks of bounded size."""
    out = np.zeros(len(start), dtype=U64)
    for at in range(0, len(data), _BLOCK):
        stop = min(at + _BLOCK, len(data))
        low, high = np.searchsorted(end, at, side="right"), np.searchsorted(start, stop)
        if low >= high:
            continue
        s, e = start[low:high], end[low:high]
        total = np.zeros(stop - at + 1, dtype=U64)
        np.cumsum((data[at:stop].astype(U64) + U64(1)) * _power_table(_BASE, stop - at), out=total[1:])
        left = np.maximum(s, at) - at
        part = total[np.minimum(e, stop) - at] - total[left]
        shift = left - (s - at)  # bytes of the span before this block
        part *= _power_table(_INVERSE, _BLOCK + 1)[left]
        longer = shift > 0
        if longer.any():
            for i in np.flatnonzero(longer):
                part[i:i + 1] *= U64(pow(_BASE, int(shift[i]), 1 << 64))
        out[low:high] += part
    return mix(out ^ (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one row, and the index of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1:])
    total = np.zeros(len(at), dtype=U64)
    for i in range(size):
        total = mix(total + words[at + i] + U64(i + 1))
    return total, at


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + count[i] - 1 of every i, in order."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of ``size``-word shingles (A-Z lower-cased) of every text.

    Returns hashes sorted by (row, hash) without repeats, their rows, and the
    set sizes. Texts of fewer words have their whole sequence as one shingle.
    """
    words = Words(*utf8(texts))
    hashes = words.hashes(lower=True)
    values, at = shingles(hashes, words.row, size)
    rows = words.row[at]
    count = np.diff(words.first)
    for few in range(1, size):
        short = np.flatnonzero(count == few)
        if len(short):
            at = gather(words.first[short], np.full(len(short), few))
            part, first = shingles(hashes[at], words.row[at], few)
            values, rows = np.concatenate([values, part]), np.concatenate([rows, words.row[at][first]])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, rows, np.bincount(rows, minlength=len(texts))
