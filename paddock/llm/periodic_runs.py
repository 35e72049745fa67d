"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least ``exponent``
times q words that no neighbouring word extends.

1. Periods below ``FIRST_SCALE`` are read off directly: words that equal the
   word q places on, in stretches of 3 q.
2. At every scale t = FIRST_SCALE, 2 FIRST_SCALE, ... each window of t words
   has a hash. Position i belongs to the scale's synchronising set if the least
   hash of windows i .. i + t is that of i or of i + t. Membership depends on
   the words i .. i + 2t - 1 only, so it repeats with every period, and every
   t neighbouring positions have a member.
3. Windows inside a stretch of period t / 4 or less (found at earlier scales)
   take no part: there every position would tie. Their periods are known.
4. Each member is paired with the next member of the same 2t words. In a run
   of period q, t <= q < 2t, that one is q places on, and a run of 4 q words is
   wide enough to hold such a pair. Each pair proposes a stretch, which is then
   compared word by word and extended to its ends.

Stretches of equal ends keep their smallest period. Work is a few array
operations a word and scale; a text takes part in scales up to a quarter of
its length.

Defined results: a null or blank text has no words and no runs; words are
compared by 64-bit hashes; repeated rows and null ids are rows like any other;
texts of any length are whole; other input columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import (_BASE, _INVERSE, U64, WHITE, Words, _power_table, gather, list_array, map_batches, mix,
                              pieces, utf8)

FIRST_SCALE = 8
NONE = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class RunRules:
    min_words: int = 6
    exponent: int = 4  # at least 4: what the synchronising sets are sure to find


def small_periods(x: np.ndarray, row: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of all maximal stretches of period q with 4 q words or more."""
    at = np.flatnonzero((x[:-q] == x[q:]) & (row[:-q] == row[q:]))
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    start, stop = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
    # equal pairs of two rows are neighbours where q words lie between them at least
    wide = stop - start >= 3 * q
    return start[wide], stop[wide] + q


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:len(values) - step], values[step:])
        reach += step
    return values


def proposals(x: np.ndarray, row: np.ndarray, end: np.ndarray, scale: int,
              periodic: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of pairs of neighbouring members with the same 2 * scale words; ``end`` is
    the end of each position's text, ``periodic`` the stretches [start, stop) of small period."""
    n = len(x)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(x * _power_table(_BASE, n), out=total[1:])
    inverse = _power_table(_INVERSE, n)

    def hashes(at, width: int) -> np.ndarray:
        return mix((total[at + width] - total[at]) * inverse[at])

    last = n - scale + 1
    ids = np.full(n, NONE, dtype=U64)
    ids[:last] = mix((total[scale:] - total[:-scale]) * inverse[:last]) >> U64(1)
    start, stop = periodic
    if len(start):
        out = np.zeros(n + 1, dtype=np.int64)
        np.add.at(out, start, 1)
        np.add.at(out, np.maximum(stop - scale + 1, start), -1)
        ids[np.cumsum(out[:-1]) > 0] = NONE
    m = least(ids, scale + 1)
    here = np.arange(len(m))
    member = np.flatnonzero((m != NONE) & ((ids[:len(m)] == m) | (ids[scale:] == m)) & (here + 2 * scale <= end[:len(m)]))
    if len(member) < 2:
        return member[:0], member[:0]
    context = hashes(member, 2 * scale) ^ mix(row[member].astype(U64) + U64(1))
    order = np.argsort(context, kind="stable")  # positions stay in order
    a, b = member[order[:-1]], member[order[1:]]
    pair = (context[order[:-1]] == context[order[1:]]) & (row[a] == row[b])
    q = b - a
    pair &= (q >= scale) & (q < 2 * scale)
    return a[pair], q[pair]


def extend(x: np.ndarray, low: int, high: int, start: int, stop: int, q: int) -> tuple[int, int]:
    """Ends of the stretch of period q around [start, stop), inside [low, high), word by word."""
    step = 64
    while stop < high:
        n = min(step, high - stop)
        other = np.flatnonzero(x[stop:stop + n] != x[stop - q:stop - q + n])
        if len(other):
            stop += int(other[0])
            break
        stop, step = stop + n, step * 4
    step = 64
    while start > low:
        n = min(step, start - low)
        other = np.flatnonzero(x[start - n:start] != x[start - n + q:start + q])
        if len(other):
            start -= n - 1 - int(other[-1])
            break
        start, step = start - n, step * 4
    return start, stop


def scale_runs(x: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, scale: int,
               periodic: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the stretches with scale <= period < 2 * scale."""
    at, q = proposals(x, row, end, scale, periodic)
    order = np.lexsort((at, q, row[at]))
    found: list[tuple[int, int, int]] = []
    for a, p in zip(at[order].tolist(), q[order].tolist(), strict=True):
        low, high = int(begin[a]), int(end[a])
        if found and found[-1][2] == p and found[-1][0] <= a < found[-1][1] and low <= found[-1][0]:
            continue  # inside the stretch that the pair before found
        if not np.array_equal(x[a:a + 2 * scale], x[a + p:a + p + 2 * scale]):
            continue  # two contexts of one hash
        found.append((*extend(x, low, high, a, a + p + 2 * scale, p), p))
    return [(s, e, p) for s, e, p in found if e - s >= 4 * p]


def find_runs(x: np.ndarray, row: np.ndarray, first: np.ndarray,
              how: RunRules = RunRules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of the rows' words, by start and period; ``first`` bounds each row."""
    parts = []
    for q in range(1, FIRST_SCALE):
        if len(x) > q:
            start, stop = small_periods(x, row, q)
            parts.append(np.stack([start, stop, np.full(len(start), q)], axis=1))
    size = np.diff(first)
    scale = FIRST_SCALE
    while len(size) and size.max() >= 4 * scale:
        rows = np.flatnonzero(size >= 4 * scale)
        at = gather(first[rows], size[rows])
        begin = np.cumsum(size[rows]) - size[rows]
        known = np.concatenate(parts)
        known = known[(4 * known[:, 2] <= scale) & (known[:, 1] - known[:, 0] >= scale)]
        known = known[size[row[known[:, 0]]] >= 4 * scale]
        shift = first[rows] - begin  # of every chosen row
        move = shift[np.searchsorted(rows, row[known[:, 0]])]
        local = np.repeat(np.arange(len(rows)), size[rows])
        found = scale_runs(x[at], local, np.repeat(begin, size[rows]), np.repeat(begin + size[rows], size[rows]), scale,
                           (known[:, 0] - move, known[:, 1] - move))
        if found:
            some = np.array(found, dtype=np.int64)
            some[:, :2] += shift[local[some[:, 0]]][:, None]
            parts.append(some)
        scale *= 2
    runs = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # multiples of a period have its ends
    runs = runs[fresh]
    length = runs[:, 1] - runs[:, 0]
    runs = runs[(length >= how.min_words) & (length >= how.exponent * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def collapsed(words: Words, dropped: np.ndarray) -> pa.StringArray:
    """Kept words of every row joined by one space."""
    mask = ~WHITE[words.data]
    gone = np.flatnonzero(dropped)
    mask[gather(words.start[gone], words.end[gone] - words.start[gone])] = False
    kept = np.flatnonzero(~dropped)
    after = kept[:-1][words.row[kept[1:]] == words.row[kept[:-1]]]
    data = words.data.copy()
    data[words.end[after]] = 32
    mask[words.end[after]] = True
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    offsets = total[words.offsets]
    kind, sort = (np.int32, pa.string()) if offsets[-1] < 1 << 31 else (np.int64, pa.large_string())
    out = pa.Array.from_buffers(sort, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(kind)),
                                                         pa.py_buffer(data[mask])])
    return out.cast(pa.string())


def periodic_runs(docs: DataFrame, how: RunRules = RunRules(), *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, starts, lengths, periods, collapsed) of every row: its runs by start and period,
    and its words without the repetitions, joined by one space. A narrow map."""
    names = [id_col, "n_words", "starts", "lengths", "periods", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(*utf8(part.column("text")))
                start, stop, period = find_runs(words.hashes(), words.row, words.first, how)
                row = words.row[start]
                depth = np.zeros(len(words.row) + 1, dtype=np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, stop, -1)
                count = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(words.first)),
                     *(list_array(pa.array(v.astype(np.int64)), count)
                       for v in (start - words.first[row], stop - start, period)),
                     collapsed(words, np.cumsum(depth[:-1]) > 0)], names)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(given, run, f"`{id_col}` long, n_words long, starts array<long>, lengths array<long>, "
                                   "periods array<long>, collapsed string")
