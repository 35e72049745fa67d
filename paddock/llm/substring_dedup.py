"""Substring dedup with compact windows.

Every text is a sequence of word shingles. Under one hash function the
positions that are the minimum of some window of at least ``min_words`` words
form a Cartesian tree; each is a compact window (l, c, r): all passages inside
[l, r] that contain c have the min-hash of c. Passages with equal min-hashes
therefore meet in the group of that value.

1. In each group the first window (smallest id) is the pivot. Every other window
   is laid on it, aligned at c; intervals of all hash functions on the same
   diagonal merge into one candidate region per (document, pivot document,
   diagonal).
2. Verification with the texts: shingles of the region that occur in the
   pivot's region form runs; runs join while ``percent`` of the passage is
   shared; passages of at least ``min_words`` words are reported.
3. Exact repeats: the runs of a passage's length inside the first function's
   windows that the pivot's region has not are grouped by their hash. The
   pivot document's other windows take part, so no repeat depends on the pivot.
4. Windows that no passage covers (a common line inside a longer passage, say)
   go into a further turn, with finer keys: the min-hash, under a new function,
   of what the pivot has not. Turns go on until no group has two windows.

No pairs within a group are made: each member meets one pivot per group and
turn. The copy in the smallest document id stays.

Defined results: null, blank or short texts have no windows; passages repeated
inside one document only are not reported; repeated ids are one document and
do not repeat each other; null ids are ignored; ties of equal hashes go to the
leftmost position; other input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.text import (_BASE, _INVERSE, U64, Words, _power_table, gather, list_array, map_batches, mix, pieces,
                              shingles, utf8)
from paddock.session import materialize


@dataclass(frozen=True)
class PassageRules:
    size: int = 5  # words per shingle
    percent: int = 80  # shared shingles of a passage
    min_words: int = 50
    hashes: int = 3  # min-hash functions; each finds an exact repeat on its own
    min_hashes: int = 1  # functions that must agree on a candidate region
    max_gap: int = 10  # unshared shingles that any runs join across; wider gaps only inside a passage
    chunk: int = 500  # documents that travel with one copy of their pivot's text

    @property
    def width(self) -> int:
        return self.min_words - self.size + 1


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = pick(values[:len(values) - step], values[step:])
        reach += step
    return values


def window_minima(values: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Positions that are a minimum of a window of ``width`` within one row (with all ties); values are above 0."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.zeros(n + 2 * (width - 1), dtype=U64)
    low[width - 1:width - 1 + n] = np.where(rows[:n] == rows[width - 1:], _sliding(values, width, np.minimum), U64(0))
    # the largest minimum of the windows around a position is its own value if it is one of them
    return np.flatnonzero(_sliding(low, width, np.maximum) == values)


def compact_windows(values: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray,
                    width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows; ``first`` and ``last`` bound each row."""
    c = window_minima(values, rows, width)
    v, row = values[c], rows[c]
    n = len(c)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    # pointer jumping to the next smaller value on either side, within the row
    here = np.arange(n)
    while len(here):
        b = np.maximum(before[here], 0)
        here = here[(before[here] >= 0) & (row[b] == row[here]) & (v[b] > v[here])]
        before[here] = before[before[here]]
    here = np.arange(n)
    while len(here):
        b = np.minimum(after[here], n - 1)
        here = here[(after[here] < n) & (row[b] == row[here]) & (v[b] >= v[here])]
        after[here] = after[after[here]]
    inside = (before >= 0) & (row[np.maximum(before, 0)] == row)
    left = np.where(inside, c[np.maximum(before, 0)] + 1, first[row])
    inside = (after < n) & (row[np.minimum(after, max(n - 1, 0))] == row) if n else np.zeros(0, bool)
    right = np.where(inside, c[np.minimum(after, max(n - 1, 0))] - 1, last[row])
    wide = right - left + 1 >= width  # of ties only the leftmost has wide windows to its left
    return left[wide], c[wide], right[wide]


class Sequences:
    """Shingle hashes of a run of texts, with the bounds of each text."""

    def __init__(self, texts: pa.Array, size: int):
        words = Words(*utf8(texts))
        self.values, at = shingles(words.hashes(lower=True), words.row, size)
        self.rows = words.row[at]
        self.first = np.searchsorted(self.rows, np.arange(len(texts)))
        self.stop = np.searchsorted(self.rows, np.arange(len(texts)), side="right")


def windows(docs: DataFrame, how: PassageRules) -> DataFrame:
    """(key, id, f, c, l, r): compact windows of every text under each hash function. A narrow map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                seq = Sequences(part.column("text"), how.size)
                ids = part.column("id").to_numpy()
                for f in range(how.hashes):
                    v = mix(seq.values ^ mix(np.full(1, f + 1, dtype=U64))) | U64(1)
                    left, c, right = compact_windows(v, seq.rows, seq.first, seq.stop - 1, how.width)
                    row = seq.rows[c]
                    base = seq.first[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[c].view(np.int64)), pa.array(ids[row]),
                         pa.array(np.full(len(c), f, dtype=np.int8)), pa.array((c - base).astype(np.int32)),
                         pa.array((left - base).astype(np.int32)), pa.array((right - base).astype(np.int32))],
                        ["key", "id", "f", "c", "l", "r"])

    return map_batches(docs, run, "key long, id long, f byte, c int, l int, r int")


def candidates(found: DataFrame, how: PassageRules) -> DataFrame:
    """(x, p, parts): every window but a group's pivot, as intervals on diagonals of the pivot document p.
    Windows that overlap the pivot's by less than a passage stay, and so do the pivot document's own others."""
    names = ["x", "p", "f", "key", "diagonal", "lo", "hi", "c", "l", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and pivot window of the group that the previous batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, f, c, left, right = (batch.column(i).to_numpy() for i in range(6))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            if last is not None and last[0] == key[0]:
                fresh[0] = False
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            old = at < 0
            pivot = [np.where(old, last[i + 1] if last is not None else 0, col[np.maximum(at, 0)])
                     for i, col in enumerate((doc, c, left, right))]
            last = (key[-1], *(col[-1] for col in pivot))
            p, pc, pl, pr = pivot
            before, beyond = np.minimum(c - left, pc - pl), np.minimum(right - c, pr - pc)
            keep = np.flatnonzero(~fresh)
            # a text that has the shingle several times is one row
            fresh = np.ones(len(keep), dtype=bool)
            fresh[1:] = (key[keep][1:] != key[keep][:-1]) | (doc[keep][1:] != doc[keep][:-1])
            lists = np.diff(np.append(np.flatnonzero(fresh), len(keep)))
            one = keep[fresh]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[one]), pa.array(p[one]), pa.array(f[one].astype(np.int8)), pa.array(key[one])]
                + [list_array(pa.array(col[keep].astype(np.int32)), lists)
                   for col in (c - pc, c - before, c + beyond, c, left, right)], names)

    ordered = found.repartition("key").sortWithinPartitions("key", "id", "c")
    star = map_batches(ordered, run, "x long, p long, f byte, key long, diagonal array<int>, lo array<int>, "
                                     "hi array<int>, c array<int>, l array<int>, r array<int>")
    # one row per pair of documents
    return star.groupBy("x", "p").agg(F.collect_list(F.struct(*names[2:])).alias("parts"))


def merged_regions(parts: pa.ListArray, how: PassageRules) -> tuple[np.ndarray, ...]:
    """(row, diagonal, lo, hi): of every list of parts, the interval of each diagonal that enough
    hash functions agree on."""
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten()
    lists = [pc.struct_field(flat, n) for n in ("diagonal", "lo", "hi")]
    size = np.diff(lists[0].offsets.to_numpy())
    row, f = np.repeat(row, size), np.repeat(pc.struct_field(flat, "f").to_numpy(), size)
    diagonal, lo, hi = (v.flatten().to_numpy() for v in lists)
    if not len(row):
        return row, diagonal, lo, hi
    order = np.lexsort((f, diagonal, row))
    row, diagonal, lo, hi, f = (v[order] for v in (row, diagonal, lo, hi, f))
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (diagonal[1:] != diagonal[:-1])
    new_f = fresh.copy()
    new_f[1:] |= f[1:] != f[:-1]
    at = np.flatnonzero(fresh)
    enough = np.add.reduceat(new_f.astype(np.int64), at) >= how.min_hashes
    return tuple(v[enough] for v in (row[at], diagonal[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))


def joined(intervals: list[tuple[int, int]]) -> list[list[int]]:
    """Half-open intervals, joined where they overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def passages(shared: np.ndarray, how: PassageRules) -> list[tuple[int, int]]:
    """Runs of shared shingles, joined across small gaps while ``percent`` of the whole is shared, and
    the best segments across any gaps; the long ones as [start, stop)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
    out: list[list[int]] = []
    for start, stop in edge.reshape(-1, 2).tolist():
        if out and start - out[-1][1] <= how.max_gap and \
                100 * (out[-1][2] + stop - start) >= how.percent * (stop - out[-1][0]):
            out[-1][1], out[-1][2] = stop, out[-1][2] + stop - start
        else:
            out.append([start, stop, stop - start])
    found = [(a, b) for a, b, _ in out if b - a >= how.width]
    return [(a, b) for a, b in joined(found + best_segments(edge.reshape(-1, 2), how))]


def best_segments(runs: np.ndarray, how: PassageRules) -> list[tuple[int, int]]:
    """The best-scoring segments from run to run that have a passage's length and ``percent`` shared, whatever
    their gaps: the best of all, then the best on either side of it. A shared shingle scores 100 - percent,
    another -percent."""
    found, left = [], [runs]
    while left:
        part = left.pop()
        if not len(part) or part[-1, 1] - part[0, 0] < how.width:
            continue
        start, stop = part[:, 0], part[:, 1]
        total = np.cumsum(stop - start)
        ends = 100 * total - how.percent * stop  # score up to a run's end, and from a run's start
        begins = 100 * (total - (stop - start)) - how.percent * start
        fits = np.searchsorted(start, stop - how.width, side="right")  # starts that are far enough back
        low = np.minimum.accumulate(begins)
        score = np.where(fits > 0, ends - low[np.maximum(fits - 1, 0)], -1)
        j = int(np.argmax(score))
        if score[j] < 0:
            continue
        i = int(np.argmin(begins[:fits[j]]))
        found.append((int(start[i]), int(stop[j])))
        left += [part[:i], part[j + 1:]]
    return found


def run_hashes(short: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours, by position."""
    # powers are odd, so a run's sum times the inverse power of its start does not depend on the start
    n = len(short) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(short) + 1, dtype=U64)
    np.cumsum(mix(short.astype(U64)) * _power_table(_BASE, len(short)), out=total[1:])
    return mix((total[width:] - total[:-width]) * _power_table(_INVERSE, n))


def among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each value is one of the others."""
    if not len(others):
        return np.zeros(len(values), dtype=bool)
    others = np.sort(others)
    at = np.searchsorted(others, values)
    return others[np.minimum(at, len(others) - 1)] == values


def window_lists(parts: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row, f, key, c, l, r) of all windows of every list of parts."""
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten()
    lists = [pc.struct_field(flat, n) for n in ("c", "l", "r")]
    size = np.diff(lists[0].offsets.to_numpy())
    return (np.repeat(row, size), np.repeat(pc.struct_field(flat, "f").to_numpy(), size),
            np.repeat(pc.struct_field(flat, "key").to_numpy(), size),
            *(v.flatten().to_numpy().astype(np.int64) for v in lists))


def _by_length(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose lists have about ``most`` entries together."""
    ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def verify(regions: DataFrame, docs: DataFrame, how: PassageRules, turn: int) -> DataFrame:
    """Rows of three kinds: ``kind`` 0, passages (x, p, start, stop); 1, in the first turn, runs of a passage's
    length that the pivot has not (key, x, start); 2, for windows that no passage covers, the windows of the
    next turn (key, x, f, c, start, stop)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "p", "spans", "parts", "content", "cuts"]
        for batch in batches:
            for part in (some for text in pieces(batch, "text") for some in _by_length(text, "asked", how.chunk)):
                seq = Sequences(part.column("text"), how.size)
                short = (seq.values >> U64(32)).astype(np.uint32)
                asked = part.column("asked")
                owner = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                flat = asked.flatten()
                row, diagonal, lo, hi = merged_regions(pc.struct_field(flat, "parts"), how)
                bound = np.searchsorted(row, np.arange(len(flat) + 1))
                spans, content, cuts = [], [], []
                for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
                    first, stop = int(seq.first[owner[i]]), int(seq.stop[owner[i]])
                    begin, end, d = lo[a:b], hi[a:b] + 1, diagonal[a:b]
                    # what a passage of the region may have inserted in either text
                    slack = np.maximum(how.max_gap, (end - begin) * (100 - how.percent) // how.percent + 1)
                    mine = joined(list(zip(np.maximum(begin - slack, 0).tolist(), (end + slack).tolist(),
                                           strict=True)))
                    other = joined(list(zip(np.maximum(begin - d - slack, 0).tolist(),
                                            np.minimum(end - d + slack, stop - first).tolist(), strict=True)))
                    other = [(u, v) for u, v in other if u < v]
                    spans.append([e for pair in mine for e in pair])
                    content.append(b"".join(short[first + u:first + v].tobytes() for u, v in other))
                    cuts.append([v - u for u, v in other])
                yield pa.RecordBatch.from_arrays(
                    [pc.struct_field(flat, "x"), part.column("p").take(pa.array(owner)),
                     pa.array(spans, pa.list_(pa.int32())), pc.struct_field(flat, "parts"),
                     pa.array(content, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))], names)

    names = ["kind", "x", "p", "start", "stop", "key", "f", "c"]
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8(), pa.int32())

    def rows(kind: int, x, p=None, start=None, stop=None, key=None, f=None, c=None) -> pa.RecordBatch:
        cols = [np.full(len(x), kind), x, p, start, stop, key, f, c]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(x), t) if v is None else pa.array(np.asarray(v, dtype=t.to_pandas_dtype()))
             for v, t in zip(cols, types, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (some for text in pieces(batch, "text") for some in _by_length(text, "regions", how.chunk)):
                seq = Sequences(part.column("text"), how.size)
                short = (seq.values >> U64(32)).astype(np.uint32)
                runs = run_hashes(short, how.width) if turn == 0 else None
                ids = part.column("x").to_numpy()
                given = part.column("regions")
                owner = np.repeat(np.arange(part.num_rows), np.diff(given.offsets.to_numpy()))
                # so many pairs at a time that their texts together stay small
                sizes = np.cumsum((seq.stop - seq.first)[owner])
                low = 0
                while low < len(owner):
                    done = sizes[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(sizes, done + (1 << 20), side="right")))
                    yield from compare_pairs(seq, short, runs, ids, owner[low:high],
                                             given.flatten().slice(low, high - low))
                    low = high

    def compare_pairs(seq: Sequences, short: np.ndarray, runs, ids: np.ndarray, owner: np.ndarray,
                      given: pa.StructArray) -> Iterator[pa.RecordBatch]:
        p, x = pc.struct_field(given, "p").to_numpy(), ids[owner]
        base, size = seq.first[owner], (seq.stop - seq.first)[owner]
        off = np.cumsum(size) - size  # of each pair's text in the arrays over all pairs
        pair = np.repeat(np.arange(len(owner), dtype=np.int64), size)
        contents = pc.struct_field(given, "content").to_pylist()
        other = np.frombuffer(b"".join(contents), dtype=np.uint32)
        length = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents)) // 4
        shared = among((pair << 32) | short[gather(base, size)].astype(np.int64),
                       (np.repeat(np.arange(len(owner)), length) << 32) | other.astype(np.int64))
        spans, covered = [], []
        for i, span in enumerate(pc.struct_field(given, "spans").to_pylist()):
            mine = shared[off[i]:off[i] + size[i]]
            covered += [(i, lo + a, lo + b) for lo, hi in zip(span[::2], span[1::2], strict=True)
                        for a, b in passages(mine[lo:hi], how)]
        spans = [(x[i], p[i], a, b) for i, a, b in covered if x[i] != p[i]]
        if spans:
            yield rows(0, *zip(*spans, strict=True))
        at, f, key, c, left, right = window_lists(pc.struct_field(given, "parts"))
        if turn == 0:
            first = np.flatnonzero(f == 0)
            low = np.maximum(left[first], c[first] - how.width + 1)
            n = np.maximum(np.minimum(c[first], right[first] - how.width + 1) - low + 1, 0)
            s, whose = base[np.repeat(at[first], n)] + gather(low, n), np.repeat(at[first], n)
            cuts = pc.struct_field(given, "cuts")
            of_pair = np.repeat(np.arange(len(owner)), np.diff(cuts.offsets.to_numpy()))
            wide = cuts.flatten().to_numpy().astype(np.int64)
            inside = np.maximum(wide - how.width + 1, 0)
            theirs = run_hashes(other, how.width)[gather(np.cumsum(wide) - wide, inside)]
            has = among(runs[s] ^ mix(whose.astype(U64)), theirs ^ mix(np.repeat(of_pair, inside).astype(U64)))
            # the pivot document's other windows stay for the others
            s = np.unique(s[~has | (x == p)[whose]])
            if len(s):
                yield rows(1, ids[seq.rows[s]], start=s - seq.first[seq.rows[s]], key=runs[s].view(np.int64))
        out, bound = np.ones(len(c), dtype=bool), np.searchsorted(at, np.arange(len(owner) + 1))
        for i, a, b in covered:
            mine = slice(bound[i], bound[i + 1])
            out[mine] &= (c[mine] < a) | (c[mine] >= b)
        # what the pivot has not decides the next groups
        which = np.flatnonzero(out)
        width = np.cumsum(right[which] - left[which] + 1)
        low = 0
        while low < len(which):
            done = width[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(width, done + (1 << 20), side="right")))
            some = which[low:high]
            yield from next_windows(seq, shared, x[at[some]], base[at[some]], off[at[some]], f[some], key[some], c[some],
                                    left[some], right[some])
            low = high

    def next_windows(seq: Sequences, shared: np.ndarray, x, base, off, f, key, c, left, right
                     ) -> Iterator[pa.RecordBatch]:
        size = right - left + 1
        segment, at = np.repeat(np.arange(len(c)), size), gather(left, size)
        seeds = mix(np.arange(1, how.hashes + 1, dtype=U64) + U64(how.hashes * (turn + 1)))
        v = mix(seq.values[base[segment] + at] ^ seeds[f[segment]])
        v = (v >> U64(1)) | U64(1) | (shared[off[segment] + at].astype(U64) << U64(63))
        first = np.cumsum(size) - size
        lo, m, hi = compact_windows(v, segment, first, first + size - 1, how.width)
        own = c[segment[m]]
        fits = (at[lo] <= own) & (own <= at[hi])
        lo, m, hi = lo[fits], m[fits], hi[fits]
        part = segment[m]
        new = mix(key[part].view(U64) ^ mix(v[m]))
        if len(m):
            yield rows(2, x[part], start=at[lo], stop=at[hi], key=new.view(np.int64), f=f[part], c=at[m])

    # a pivot document's text goes with its regions in chunks of bounded size, however many there are
    many = regions.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / how.chunk))
    asked = regions.join(many, "p").groupBy("p", chunk.alias("chunk")).agg(
        F.collect_list(F.struct("x", "parts")).alias("asked"))
    pivots = asked.join(docs.select(F.col("id").alias("p"), "text"), "p").select("p", "text", "asked")
    parts = regions.schema["parts"].dataType.simpleString()
    other = map_batches(pivots, cut, f"x long, p long, spans array<int>, parts {parts}, content binary, "
                                     "cuts array<int>")
    grouped = other.groupBy("x").agg(
        F.collect_list(F.struct("p", "spans", "parts", "content", "cuts")).alias("regions"))
    members = grouped.join(docs.select(F.col("id").alias("x"), "text"), "x").select("x", "text", "regions")
    return map_batches(members, compare, "kind byte, x long, p long, start int, stop int, key long, f byte, c int")


def exact_runs(runs: DataFrame, how: PassageRules) -> DataFrame:
    """(x, p, start, stop): of equal runs of a passage's length, all but those of the smallest document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, start = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            fresh[0] = last is None or last[0] != key[0]
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            p = np.where(at < 0, last[1] if last is not None else 0, x[np.maximum(at, 0)])
            last = key[-1], p[-1]
            keep = x != p
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[keep].astype(np.int64)) for v in (x, p, start, start + how.width)],
                ["x", "p", "start", "stop"])

    ordered = runs.repartition("key").sortWithinPartitions("key", "x", "start")
    return map_batches(ordered.select("key", "x", "start"), run, "x long, p long, start long, stop long")


def repeated_passages(docs: DataFrame, how: PassageRules = PassageRules(), *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, ref_doc_ids): passages of a document that documents
    with smaller ids (one of each group of texts) have too, as half-open word ranges."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        "id IS NOT NULL")
    found, spans, turn = windows(docs, how), None, 0
    while True:  # every group loses its pivot in a turn, so nothing is left at last
        regions = materialize(candidates(found, how), "regions")
        checked = materialize(verify(regions, docs, how, turn), "passages")
        some = checked.filter("kind = 0").select("x", "p", F.col("start").cast("long"), F.col("stop").cast("long"))
        spans = some.unionByName(exact_runs(checked.filter("kind = 1"), how)) if spans is None else \
            spans.unionByName(some)
        found = checked.filter("kind = 2").select("key", F.col("x").alias("id"), "f", "c", F.col("start").alias("l"),
                                                  F.col("stop").alias("r"))
        turn += 1
        if found.isEmpty():
            break
    return merged_spans(spans, how).select(
        F.col("x").alias(id_col), F.col("start").alias("start_word"), F.col("stop").alias("end_word"),
        (F.col("stop") - F.col("start")).alias("n_words"), F.col("refs").alias(f"ref_{id_col}s"))


def merged_spans(spans: DataFrame, how: PassageRules) -> DataFrame:
    """Overlapping passages of a document as one word range with the documents that have parts of it."""
    once = spans.groupBy("x", "start", "stop").agg(F.collect_set("p").alias("ps"))
    order = Window.partitionBy("x").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(order)
    return once.withColumn("before", before).withColumn("island", island).groupBy("x", "island").agg(
        F.min("start").alias("start"), (F.max("stop") + how.size - 1).alias("stop"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("refs"))


def drop_passages(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with the words of the found passages cut out of the text; all columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts_of, texts = batch.column("__cut_spans").to_pylist(), batch.column(text_col).to_pylist()
            for i, (text, cut) in enumerate(zip(texts, cuts_of, strict=True)):
                if text is None or not cut:
                    continue
                raw = text.encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                out, at = [], 0
                for s in sorted(cut, key=lambda s: s["a"]):
                    a, b = int(words.start[s["a"]]), int(words.end[s["b"] - 1])
                    if a > at:
                        out.append(raw[at:a])
                    at = max(at, b)
                texts[i] = b"".join([*out, raw[at:]]).decode()
            cols = [pa.array(texts, pa.string()) if name == text_col else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    names, spans, cut_id = docs.columns, "__cut_spans", "__cut_id"
    cuts = found.groupBy(F.col(id_col).alias(cut_id)).agg(
        F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias(spans))
    joined = docs.join(cuts, F.col(id_col) == F.col(cut_id), "left").select(*names, spans)
    return map_batches(joined, run, docs.schema)
