"""Exact removal of repeated byte strings with a family of suffix indexes.

A byte is removed if a string of ``length`` bytes that covers it starts
somewhere else too, in any text. A full suffix array holds one entry a byte;
this index is sparse. Every window of ``length`` bytes picks one suffix inside
it, the one whose first ``gram`` bytes hash lowest, so equal windows pick the
same suffix at the same place. Neighbouring windows share their suffix; an
entry is a suffix with all windows that picked it:

    key   fingerprint of the suffix's first ``gram`` bytes: the sort order
    ext   fingerprint of the bytes that all its windows cover together
    rid   text, and ``at``: first window, number of windows, place of the suffix

1. A batch's entries are grouped and sorted by key: its suffix array (equal
   suffixes are one row with a count and the least and greatest ext).
2. The array is merge-joined with every existing level. Keys in both, and keys
   that the batch itself has twice, are matches.
3. Levels of equal size merge, so of n batches at most log2 n + 1 levels are
   searched and a row is rewritten at most log2 n times.
4. Matches of one ext repeat in all their windows. Where a key has several
   exts, the bytes of one suffix of each are fetched and their windows
   compared one by one. Keys of more than ``most`` exts are spread by window
   instead, so no group is held by one task.
5. Repeated windows mark their bytes; a text's marks cut its bytes.

Fingerprints have 64 bits; two of them agree wherever strings are taken as
equal (key with ext, key with window).

Defined results: a null text is empty; texts below ``length`` bytes stay whole;
repeated rows (null ids too) are texts of their own, so each repeats the
others; strings never cross texts; a kept text is bytes, because a cut may fall
inside a character; other input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import (_BASE, _INVERSE, U64, _power_table, gather, list_array, map_batches, mix,
                              pieces, utf8)
from paddock.session import materialize, scratch_path

LETTER = mix(np.arange(1, 257, dtype=U64))  # a random number for every byte value
_LOW = U64(0xFFFFFFFF)
_ORDER = U64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class SuffixRules:
    length: int = 200  # bytes of a repeated string
    gram: int = 40  # bytes that a suffix is sorted by
    most: int = 8_000  # exts of a key that one task compares, in about 50 MB
    block: int = 1 << 20  # bytes that are indexed at a time

    def __post_init__(self):
        # a window holds its suffix's gram; counts and places take a byte each in ``at``
        if not 0 < self.gram <= self.length < self.gram + 255:
            raise ValueError("length must be at least gram, and below gram + 255")

    @property
    def span(self) -> int:
        return self.length - self.gram + 1  # places of a suffix in a window


class Fingerprints:
    """Fingerprints of the byte strings [at, at + size) of one buffer."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(LETTER[data] * _power_table(_BASE, len(data)), out=self.total[1:])
        self.inverse = _power_table(_INVERSE, len(data) + 1)

    def raw(self, size: int) -> np.ndarray:
        return (self.total[size:] - self.total[:-size]) * self.inverse[:len(self.total) - size]

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.inverse[at])


def picked(data: np.ndarray, offsets: np.ndarray, how: SuffixRules) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, number of windows, place of the suffix in the first, key, ext) of every
    entry of the buffer's rows, in blocks of bounded size."""
    span, length = how.span, how.length
    for base in range(0, len(data), how.block):
        low, high = max(base - span, 0), min(base + how.block + length, len(data))
        part = data[low:high]
        n = len(part) - length + 1  # windows
        if n <= 0:
            continue
        prints = Fingerprints(part)
        value = ((prints.raw(how.gram) * _ORDER) & ~_LOW) | np.arange(len(part) - how.gram + 1, dtype=U64)
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            value = np.minimum(value[:len(value) - step], value[step:])
            reach += step
        owner = (value & _LOW).astype(np.int64)
        # windows that cross the end of a row are none
        a, b = np.searchsorted(offsets, [low, high])
        ends = np.unique(offsets[a:b + 1]) - low
        before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        first = np.clip(np.maximum(before, ends - length + 1), 0, n)
        out = gather(first, np.clip(ends, 0, n) - first)
        owner[out] = -1
        cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        start, stop = np.append(0, cut), np.append(cut, n)
        c = owner[start]
        mine = (c >= 0) & (c >= base - low) & (c < base - low + how.block)
        start, stop, c = start[mine], stop[mine], c[mine]
        count, place = stop - start, c - start
        shape = (count << 8 | place).astype(U64)
        ext = mix(prints.of(start, stop - 1 + length - start) ^ mix(shape + U64(1)))
        row = np.searchsorted(offsets, start + low, side="right") - 1
        yield row, start + low - offsets[row], count, place, prints.of(c, how.gram), ext


def entries(docs: DataFrame, how: SuffixRules = SuffixRules()) -> DataFrame:
    """(key, ext, rid, at) of all suffixes that the windows of every text pick. A narrow map over (rid, text)."""
    names = ["key", "ext", "rid", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rid = part.column("rid").to_numpy()
                for row, first, count, place, key, ext in picked(*utf8(part.column("text")), how):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ext.view(np.int64)), pa.array(rid[row]),
                         pa.array(first << 16 | count << 8 | place)], names)

    return map_batches(docs.select("rid", "text"), run, "key long, ext long, rid long, at long")


@dataclass
class SuffixIndex:
    """Levels of sorted suffix tables of 1, 2, 4, ... batches, and the matches found so far."""

    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of entries; returns (key, low, high) of the keys that it has twice or that
        an earlier batch has, with the least and greatest ext on both sides."""
        array = materialize(batch.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("ext").alias("low"), F.max("ext").alias("high"))
            .sortWithinPartitions("key"), "suffixes")
        hits = array.filter("n > 1").select("key", "low", "high")
        for _, level in self.levels:
            old = level.select("key", F.col("low").alias("low2"), F.col("high").alias("high2"))
            hits = hits.unionByName(array.join(old, "key").select(
                "key", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
        hits = materialize(hits.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")), "hits")
        self.found.append(hits)
        self.levels.append((1, array))
        return hits

    def settle(self) -> None:
        """Merge levels of equal size, the youngest first. Called before a batch is added, so the last
        batch's merges wait until another one comes."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("key").agg(
                F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            self.levels.append((2 * size, materialize(merged.sortWithinPartitions("key"), "level")))

    def matches(self) -> DataFrame:
        """(key, mixed) of all keys with more than one suffix; mixed: of several exts."""
        every = self.found[0]
        for more in self.found[1:]:
            every = every.unionByName(more)
        return every.groupBy("key").agg((F.min("low") != F.max("high")).alias("mixed"))


def fetch(asked: DataFrame, docs: DataFrame, how: SuffixRules) -> DataFrame:
    """(key, ext, place, many, content): the bytes that the windows of each asked suffix cover."""
    names = ["key", "ext", "place", "many", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = utf8(part.column("text"))
                asked = part.column("asked")
                row = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                flat = asked.flatten()
                at = pc.struct_field(flat, "at").to_numpy()
                size = (at >> 8 & 255) - 1 + how.length
                for low in range(0, len(at), 1 << 13):
                    s = slice(low, low + (1 << 13))
                    body = data[gather(offsets[row[s]] + (at[s] >> 16), size[s])]
                    ends = np.append(0, np.cumsum(size[s])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pc.struct_field(flat, n).slice(low, 1 << 13) for n in ("key", "ext")]
                        + [pa.array((at[s] & 255).astype(np.int16)), pc.struct_field(flat, "many").slice(low, 1 << 13),
                           pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                                 [None, pa.py_buffer(ends), pa.py_buffer(body)])], names)

    lists = asked.groupBy("rid").agg(F.collect_list(F.struct("key", "ext", "at", "many")).alias("asked"))
    return map_batches(docs.join(lists, "rid").select("text", "asked"), run,
                       "key long, ext long, place short, many boolean, content binary")


def window_prints(part: pa.RecordBatch, how: SuffixRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, fingerprint with the key) of every window of a batch of fetched contents."""
    data, offsets = utf8(part.column("content"))
    count = np.diff(offsets) - how.length + 1
    at = gather(offsets[:-1], count)
    row = np.repeat(np.arange(part.num_rows), count)
    key = part.column("key").to_numpy().view(U64)
    place = part.column("place").to_numpy().astype(np.int64)[row] - (at - offsets[row])  # of the suffix in the window
    prints = Fingerprints(data).of(at, how.length)
    return row, at - offsets[row], mix(prints ^ mix(key[row] + place.astype(U64)))


def repeated_windows(contents: DataFrame, how: SuffixRules) -> DataFrame:
    """(key, ext, windows): of every ext of keys with at most ``most``, which windows another ext has,
    or all if ``many`` suffixes have the ext."""
    names = ["key", "ext", "windows"]

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        row, window, prints = window_prints(part, how)
        ext = part.column("ext").to_numpy()
        order = np.lexsort((ext[row], prints))
        same = prints[order][1:] == prints[order][:-1]
        other = same & (ext[row][order][1:] != ext[row][order][:-1])
        # a group of equal windows repeats if it has two exts
        group = np.append(0, np.cumsum(~same))
        several = np.zeros(group[-1] + 1 if len(order) else 0, dtype=bool)
        several[group[1:][other]] = True
        hit = np.zeros(len(row), dtype=bool)
        hit[order] = several[group[:len(order)]]
        hit |= part.column("many").to_numpy(zero_copy_only=False)[row]
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("ext"),
             list_array(pa.array(window[hit].astype(np.int16)), np.bincount(row[hit], minlength=part.num_rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the last key, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield judge(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None:
            yield judge(rest)

    ordered = contents.repartition("key").sortWithinPartitions("key")
    return map_batches(ordered, run, "key long, ext long, windows array<short>")


def spread_windows(contents: DataFrame, how: SuffixRules) -> DataFrame:
    """As ``repeated_windows``, for keys of any number of exts: windows meet in a grouped count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                row, window, prints = window_prints(part, how)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(take), part.column("ext").take(take), part.column("many").take(take),
                     pa.array(window.astype(np.int16)), pa.array(prints.view(np.int64))],
                    ["key", "ext", "many", "window", "print"])

    rows = materialize(map_batches(contents, run, "key long, ext long, many boolean, window short, print long"),
                       "windows")
    again = rows.groupBy("key", "print").agg(
        F.min("ext").alias("low"), F.max("ext").alias("high"), F.max("many").alias("many")).filter(
        "low <> high OR many").select("key", "print")
    return rows.join(again, ["key", "print"]).groupBy("key", "ext").agg(F.collect_set("window").alias("windows"))


def cut_repeats(docs: DataFrame, spans: DataFrame, how: SuffixRules) -> DataFrame:
    """(doc_id, n_bytes, starts, stops, kept): every row's removed byte runs and its other bytes."""
    names = ["id", "n_bytes", "starts", "stops", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = utf8(part.column("text"))
                spans = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                at = pc.struct_field(flat, "at").to_numpy()
                first, count = offsets[row] + (at >> 16), at >> 8 & 255
                lists = pc.struct_field(flat, "windows")
                whole = lists.is_null().to_numpy(zero_copy_only=False)
                size = np.where(whole, 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                some = lists.flatten().to_numpy().astype(np.int64)
                start = np.concatenate([first[whole], np.repeat(first, size) + some])
                stop = np.concatenate([(first + count - 1)[whole], np.repeat(first, size) + some]) + how.length
                depth = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(depth, start, 1)
                np.add.at(depth, stop, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.zeros(len(data) + 1, dtype=bool)  # a run of one row ends at its row's end
                edge[offsets] = True
                begins = gone.copy()
                begins[1:] &= ~gone[:-1] | edge[1:-1]
                ends = gone.copy()
                ends[:-1] &= ~gone[1:] | edge[1:-1]
                begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                owner = np.searchsorted(offsets, begins, side="right") - 1
                runs = np.bincount(owner, minlength=part.num_rows)
                total = np.append(0, np.cumsum(~gone))[offsets]
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows,
                                             [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)),
                     *(list_array(pa.array((v - offsets[owner]).astype(np.int64)), runs) for v in (begins, ends)),
                     kept.cast(pa.binary())], names)

    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    given = docs.join(lists, "rid", "left").select("id", "text", F.coalesce("spans", F.array()).alias("spans"))
    return map_batches(given, run, "id long, n_bytes long, starts array<long>, stops array<long>, kept binary")


def repeated_spans(docs: DataFrame, how: SuffixRules, batches: int) -> DataFrame:
    """(rid, at, windows): entries of the (rid, text) rows with a repeated window; null windows: all of them."""
    path = scratch_path(docs.sparkSession, "suffix-entries")
    entries(docs, how).withColumn("batch", F.pmod(F.xxhash64("rid"), F.lit(batches))).write.partitionBy("batch").parquet(
        path)
    every = docs.sparkSession.read.schema("key long, ext long, rid long, at long, batch int").parquet(path)
    index = SuffixIndex()
    for number in range(batches):
        index.settle()
        index.add(every.filter(F.col("batch") == number).drop("batch"))
    # a written table, so that the join may split a frequent key
    matches = materialize(index.matches(), "matches")
    hits = materialize(every.drop("batch").join(matches, "key"), "suffix-hits")
    plain = hits.filter("NOT mixed").select("rid", "at", F.lit(None).cast("array<short>").alias("windows"))
    mixed = hits.filter("mixed")
    exts = materialize(mixed.groupBy("key", "ext").agg(
        (F.count(F.lit(1)) > 1).alias("many"), F.min(F.struct("rid", "at")).alias("one")), "exts")
    large = materialize(exts.groupBy("key").count().filter(F.col("count") > how.most).select(
        F.col("key").alias("large_key")), "large-keys")
    asked = exts.join(large, F.col("key") == F.col("large_key"), "left").select(
        "key", "ext", "many", "one.*", F.col("large_key").isNotNull().alias("large"))
    small = repeated_windows(fetch(asked.filter("NOT large"), docs, how), how)
    judged = small if large.isEmpty() else small.unionByName(
        spread_windows(fetch(asked.filter("large"), docs, how), how))
    judged = materialize(judged.filter(F.size("windows") > 0), "repeated-windows").dropDuplicates(["key", "ext"])
    return plain.unionByName(mixed.join(judged, ["key", "ext"]).select("rid", "at", "windows"))


def drop_repeats(docs: DataFrame, how: SuffixRules = SuffixRules(), *, batches: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, stops, kept) of every row: the half-open byte runs that repeat elsewhere,
    and the other bytes. Rows come in ``batches`` by a hash, as a growing corpus would deliver them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # rows of one id and text have the same runs, so they may share a row id
    given = given.withColumn("rid", F.xxhash64("id", F.lit("/"), "text"))
    spans = repeated_spans(given.select("rid", "text"), how, batches)
    return cut_repeats(given, spans, how).withColumnRenamed("id", id_col)
