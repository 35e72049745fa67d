"""Benchmark decontamination with SimHash windows and a multi-index Hamming search.

The benchmark is the query set; it is taken in blocks of bounded size and every
block is held against all documents in one narrow map (no shuffle of texts).

1. Items are classed by length. A class has windows of ``c`` shingles, shorter
   than half an item, and a document stride ``s`` with c + 3 * s - 1 <= item
   length: whichever way an item lies in a document, three document windows lie
   wholly inside it, so edits seldom touch all of them. The item has fingerprints
   at all offsets.
2. A window's SimHash is the majority of its shingles' hash bits, from prefix
   sums. Fingerprints are cut into four 16-bit blocks and indexed by every
   value within two flips of each block, so all pairs within Hamming distance
   11 are found (pigeonhole), and no other pair passes the popcount.
3. Windows alone miss a few edited items. Any set of an item's shingles that
   reaches ``percent`` of its weight has one of the item's heaviest (rarest)
   shingles that weigh more than the rest may miss; an exact hit of one of
   these seeds is a candidate too, so none above ``percent`` is lost.
4. Candidates are verified: the weight of the item's shingles that occur in
   the aligned item-sized region of the document, over the item's weight, must
   reach ``percent``. A shingle weighs 1 / (number of items that have it).

Words are runs of letters and digits, A-Z lower-cased, so case and punctuation
do not hide a passage. Defined results: null or blank texts and items match
nothing; an item shorter than a shingle is one shingle and matches as a whole;
repeated rows are reported per distinct (document, item); repeated item texts
are reported per item; very long texts are taken whole; other input columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import U64, Words, gather, map_batches, pieces, shingles, utf8

NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
_FLIPS = np.array([sum(1 << b for b in f) for n in range(3) for f in combinations(range(16), n)], dtype=np.int64)


@dataclass(frozen=True)
class LeakRules:
    size: int = 5  # words per shingle
    percent: int = 80
    radius: int = 11  # Hamming distance; four blocks with two flips guarantee up to 11
    window_share: float = 0.4  # window of a class over its shortest item
    windows: int = 3  # document windows that lie in an item, wherever it is
    class_ratio: float = 1.3
    seeds: bool = True  # complete the windows' candidates by exact hits of rare shingles
    block_items: int = 2_000  # benchmark items per block, on average
    block_chars: int = 4_000_000  # and characters


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, Words]:
    words = Words(*utf8(texts), separators=NOT_ALNUM)
    return words.hashes(lower=True), words


_LANES = U64(0x0001000100010001)  # the lowest bit of four 16-bit counters


def bit_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the hash bits: row j counts the bits j, j + 16, j + 32 and j + 48 in four
    16-bit counters of one integer. Differences of windows below 2^15 are exact in every counter."""
    out = np.zeros((16, len(values) + 1), dtype=U64)
    for j in range(16):
        np.cumsum((values >> U64(j)) & _LANES, out=out[j, 1:])
    return out


def simhash(sums: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of the windows [start, start + width): the bits that most of its hashes have."""
    lift = U64((1 << 15) - 1 - width // 2) * _LANES  # a majority reaches the counter's top bit
    stop, out = start + width, np.zeros(len(start), dtype=U64)
    for j in range(16):
        out |= (((sums[j][stop] - sums[j][start] + lift) >> U64(15)) & _LANES) << U64(j)
    return out


class WindowClass:
    """Fingerprints of the items of one length class and their block index."""

    def __init__(self, items: list[tuple[int, np.ndarray]], shortest: int, share: float, windows: int):
        self.width = min(max(1, int(np.ceil(share * shortest))), 1 << 14)
        self.stride = max(1, (shortest - self.width + 1) // windows)
        prints, owner, offset = [], [], []
        for i, values in items:
            start = np.arange(len(values) - self.width + 1)
            prints.append(simhash(bit_sums(values), start, self.width))
            owner.append(np.full(len(start), i))
            offset.append(start)
        self.prints, self.owner, self.offset = map(np.concatenate, (prints, owner, offset))
        self.index = []
        for b in range(4):
            block = ((self.prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            key = (block[:, None] ^ _FLIPS[None, :]).ravel()
            order = np.argsort(key, kind="stable")
            self.index.append((np.searchsorted(key[order], np.arange(65537)),
                               np.repeat(np.arange(len(block)), len(_FLIPS))[order]))

    def search(self, found: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, fingerprint) within ``radius``, a pair once per agreeing block."""
        hits = []
        for b, (first, entries) in enumerate(self.index):
            block = ((found >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            low = first[block]
            count = first[block + 1] - low
            window = np.repeat(np.arange(len(found)), count)
            entry = entries[gather(low, count)]
            near = np.bitwise_count(found[window] ^ self.prints[entry]) <= radius
            hits.append((window[near], entry[near]))
        return np.concatenate([w for w, _ in hits]), np.concatenate([e for _, e in hits])


class Benchmark:
    """One block of items: shingles, weights and window classes per shingle size."""

    def __init__(self, ids: list[int], texts: list[str], rules: LeakRules):
        hashes, words = hashed_words(pa.array(texts, pa.string()))
        self.ids, self.rules, self.items = ids, rules, []
        seen: dict[tuple[int, int], int] = {}
        for i in range(len(texts)):
            own = hashes[words.first[i]:words.first[i + 1]]
            size = min(rules.size, len(own))
            values = shingles(own, np.zeros(len(own)), size)[0] if size else np.zeros(0, U64)
            self.items.append((size, values))
            for v in set(values.tolist()):
                seen[size, v] = seen.get((size, v), 0) + 1
        self.weights = [{v: 1 / seen[size, v] for v in set(values.tolist())} for size, values in self.items]
        self.seeds = {size: self._seeds(size) for size in {s for s, _ in self.items if s}}
        self.classes: dict[int, list[WindowClass]] = {}
        for size in {s for s, _ in self.items if s}:
            own = sorted(((i, v) for i, (s, v) in enumerate(self.items) if s == size), key=lambda x: len(x[1]))
            while own:
                shortest = len(own[0][1])
                group = [x for x in own if len(x[1]) < max(shortest * rules.class_ratio, shortest + 1)]
                self.classes.setdefault(size, []).append(WindowClass(group, shortest, rules.window_share, rules.windows))
                own = own[len(group):]

    def _seeds(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, item, offset), by shingle: of each item the heaviest shingles, with all their places,
        that weigh more than a leak may miss."""
        found: list[tuple[int, int, int]] = []
        for i, (own, values) in enumerate(self.items):
            if own != size:
                continue
            weights, places = self.weights[i], {}
            for offset, v in enumerate(values.tolist()):
                places.setdefault(v, []).append(offset)
            spare = (100 - self.rules.percent) / 100 * sum(weights.values()) + 1e-6
            for v in sorted(weights, key=lambda v: (-weights[v], v)):
                found += [(v, i, offset) for offset in places[v]]
                spare -= weights[v]
                if spare < 0:
                    break
        found.sort()
        v, item, offset = zip(*found, strict=True)
        return np.array(v, dtype=U64), np.array(item, dtype=np.int64), np.array(offset, dtype=np.int64)

    def seeded(self, size: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, begin of the item) of every seed in a run of shingles."""
        v, item, offset = self.seeds[size]
        hit = np.flatnonzero(np.isin(values, v))
        low = np.searchsorted(v, values[hit])
        count = np.searchsorted(v, values[hit], side="right") - low
        at, entry = np.repeat(hit, count), gather(low, count)
        return at, item[entry], at - offset[entry]

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of every item found in a run of texts."""
        hashes, words = hashed_words(texts)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        rows = np.arange(len(texts))
        for size, classes in self.classes.items():
            values, at = shingles(hashes, words.row, size)
            owner = words.row[at]
            first, stop = np.searchsorted(owner, rows), np.searchsorted(owner, rows, side="right")
            sums = bit_sums(values)
            places: set[tuple[int, int, int]] = set()
            if self.rules.seeds:
                hit, item, begin = self.seeded(size, values)
                places.update(zip(owner[hit].tolist(), item.tolist(), begin.tolist(), strict=True))
            for kind in classes:
                count = np.maximum((stop - first - kind.width) // kind.stride + 1, 0)
                count[stop - first < kind.width] = 0
                which = np.repeat(rows, count)
                start = first[which] + (gather(np.zeros(len(rows), np.int64), count)) * kind.stride
                w, e = kind.search(simhash(sums, start, kind.width), self.rules.radius)
                begin = start[w] - kind.offset[e]
                places.update(zip(which[w].tolist(), kind.owner[e].tolist(), begin.tolist(), strict=True))
            for row, item, p in places:
                weights = self.weights[item]
                long = len(self.items[item][1])
                low, high = max(first[row], p - long // 8), min(stop[row], p + long + long // 8)
                shared = set(values[low:high].tolist())
                likeness = sum(x for v, x in weights.items() if v in shared) / sum(weights.values())
                if 100 * likeness >= self.rules.percent - 1e-9:
                    word = int(at[max(first[row], p)] - words.first[row])
                    best[row, item] = max(best.get((row, item), (0.0, 0)), (likeness, -word))
        return [(row, item, likeness, -word) for (row, item), (likeness, word) in sorted(best.items())]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), *,
                    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, similarity, start_word): every benchmark item found in a document."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, similarity double, start_word long"
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // rules.block_items), -(-size.chars // rules.block_chars))
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        ids, texts = [r.item for r in part], [r.text or "" for r in part]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            known = Benchmark(ids, texts, rules)
            for batch in batches:
                for some in pieces(batch, "text"):
                    found = known.leaks(some.column("text"))
                    own = some.column("id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own[r] for r, *_ in found], pa.int64()),
                         pa.array([ids[i] for _, i, *_ in found], pa.int64()),
                         pa.array([x for *_, x, _ in found], pa.float64()),
                         pa.array([w for *_, w in found], pa.int64())], ["id", "item", "similarity", "start_word"])

        found = map_batches(docs, run, schema)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("id", "item").agg(F.max(F.struct("similarity", -F.col("start_word"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m.similarity"),
                       (-F.col("m.col2")).alias("start_word"))
