"""Exact Jaccard join of word-shingle sets in metric space.

Jaccard distance and symmetric difference are metrics on the sets, and two
sets at Jaccard similarity >= t differ in at most k = (a + b)(1 - t)/(1 + t)
shingles. Distances between sparse sets are nearly all 1, so document pivots
alone would put every document on every boundary. The space is cut in three
steps, each exact:

1. Pivot "empty set": the distance to it is the set size. Sizes form shells;
   the triangle-inequality window replicates a document near a shell's upper
   bound into the next shell.
2. Inside a shell the shingle universe is cut into m = k + 1 + e slices by
   hash. The slices are subspaces whose distances add up, so two near sets
   coincide in at least e + 1 of them. Every distinct projection is a pivot of
   its subspace and its cell is a region. The few sets with more than e empty
   slices also meet by them: in the regions of their (e + 1)-subsets of empty
   slices where k is small, else in one region of the shell. So nothing is
   lost, and unrelated sets do not meet in an empty slice.
   Regions take the name of their smallest id and those of one name merge: a
   cluster that coincides in many slices becomes one region.
3. Members carry their counts in hash buckets, about two to four shingles in
   each; the L1 distance of counts never exceeds the symmetric difference. Within a region a member beyond the
   radius of all pivots becomes a pivot, every other belongs to the Voronoi cell
   of its closest pivot: one pair each, verified with the texts. Members that
   only met by chance part without looking at a text.
4. Recursion on what is left: a region's largest component so far stays as it
   is; its other members meet those members of the region, in any other
   component, that the bound does not exclude. These pairs are verified too.

Pairs within a component are never needed, so a group of copies costs one pair
a member. Equal sets are grouped before the join and represented by the smallest
id. The result has every document's component under the links.

Defined results: a null or blank text has an empty set and links with nothing;
texts shorter than a shingle are one shingle; repeated ids are one document,
linked by every text of its rows, and keep their rows; rows without an id link
with nothing and get a null component; other input columns are ignored; an empty table gives an empty result. 64-bit shingle
hashes stand for the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.components import components
from paddock.llm.text import U64, list_array, map_batches, mix, pieces, shingle_sets
from paddock.session import materialize


@dataclass(frozen=True)
class JaccardJoin:
    """Words per shingle; similarity at least ``percent`` / 100."""

    size: int = 5
    percent: int = 80
    shell_ratio: float = 1.5
    extra_slices: int = 2
    buckets: int = 128  # at least; doubled until a set has at most four shingles a bucket

    few: int = 10  # up to so many differing shingles, subsets of empty slices are enumerated

    def spare(self, differ: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        """Slices beyond differ + 1, so that few sets of at least ``smallest`` shingles have more
        empty slices: their mean number and three standard deviations."""
        spare = np.full(len(differ), self.extra_slices)
        for _ in range(3):
            m = differ + 1 + spare
            mean = m * np.exp(-smallest / m)
            spare = self.extra_slices + np.ceil(mean + 3 * np.sqrt(mean)).astype(np.int64)
        return np.where(differ > self.few, spare, self.extra_slices)

    def radius(self, a, b):
        """Largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def shells(self, largest: int) -> np.ndarray:
        """Lower bounds of the size shells up to and beyond ``largest``; a partner
        of a set is in its own shell, the one below or the one above."""
        ratio, bounds = max(self.shell_ratio, 100 / self.percent), [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * ratio))))
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * ratio))))
        return np.array(bounds, dtype=np.int64)


def regions(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray, how: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of every set (steps 1 and 2), sorted by row, and their count per row."""
    bounds = how.shells(int(sizes.max(initial=1)))
    home = np.searchsorted(bounds, sizes, side="right") - 1
    keys, owners = [], []
    scrambled = mix(values)
    first = np.cumsum(sizes) - sizes
    for step in (0, 1):
        shell = home + step
        member = sizes > 0
        if step:  # the window: sizes that a partner in the next shell can have
            member &= sizes * 100 // how.percent >= bounds[np.maximum(shell, 1)]
        if not member.any():
            continue
        upper = bounds[np.minimum(shell, len(bounds) - 2) + 1] - 1
        differ = how.radius(upper, upper)
        spare = how.spare(differ, bounds[shell] * how.percent // 100)
        slices = np.where(differ > 0, differ + 1 + spare, 1)
        use = member[rows]
        r, h, s = rows[use], values[use], scrambled[use]
        part = ((h >> U64(32)) * slices[r].astype(U64)) >> U64(32)  # ascending within a row
        fresh = np.ones(len(r), dtype=bool)
        fresh[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(s, at)
        tag = mix((shell[r[at]].astype(U64) << U64(32)) + part[at])
        keys.append(mix(total ^ tag))
        owners.append(r[at])
        filled = np.bincount(r[at], minlength=len(sizes))
        sparse = member & (slices - filled > spare) & (slices > 1)
        for row in np.flatnonzero(sparse & (differ <= how.few)):
            own = (values[first[row]:first[row] + sizes[row]] >> U64(32)) * U64(slices[row]) >> U64(32)
            empty = np.setdiff1d(np.arange(slices[row]), own.astype(np.int64))
            subsets = np.array(list(combinations(empty.tolist(), int(spare[row]) + 1)), dtype=U64)
            total = np.full(len(subsets), (int(shell[row]) << 40) + 0xE3, dtype=U64)
            for i in range(subsets.shape[1]):
                total = mix(total + subsets[:, i] + U64(1))
            keys.append(total)
            owners.append(np.full(len(subsets), row))
        row = np.flatnonzero(sparse & (differ > how.few))
        keys.append(mix((shell[row].astype(U64) << U64(40)) + U64(0x7F)))
        owners.append(row)
    if not keys:
        return np.zeros(0, U64), np.zeros(len(sizes), np.int64)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    return keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))


def signed(docs: DataFrame, how: JaccardJoin) -> DataFrame:
    """(id, n, h1, h2, counts, keys): set size, 128-bit digest of the set, its counts in hash
    buckets (at most 255 each, which keeps the bound) and region keys. A narrow map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, rows, sizes = shingle_sets(part.column("text"), how.size)
                keys, counts = regions(values, rows, sizes, how)
                full = np.flatnonzero(sizes)
                digests = []
                for salt in (U64(0x5851F42D4C957F2D), U64(0x2545F4914F6CDD1D)):
                    out = np.zeros(len(sizes), dtype=U64)
                    if len(full):
                        out[full] = np.add.reduceat(mix(values ^ salt), (np.cumsum(sizes) - sizes)[full])
                    digests.append(pa.array(out.view(np.int64)))
                filled = sketches(values, sizes, how.buckets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes.astype(np.int64)), *digests, pa.array(filled, pa.binary()),
                     list_array(pa.array(keys.view(np.int64)), counts)], ["id", "n", "h1", "h2", "counts", "keys"])

    return map_batches(docs, run, "id long, n long, h1 long, h2 long, counts binary, keys array<long>")


def named_regions(members: DataFrame) -> DataFrame:
    """(region, x): members of regions of two or more ids, under the region's smallest
    id. Rows of a region are streamed in order; only the current name is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and name of the region that the previous batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x = (batch.column(i).to_numpy() for i in (0, 1))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(fresh)
            name = x[at]
            if last is not None and last[0] == key[0]:
                name = name.copy()
                name[0] = last[1]
            region = np.repeat(name, np.diff(np.append(at, len(key))))
            last = (key[-1], region[-1])
            other = region != x
            yield pa.RecordBatch.from_arrays([pa.array(region[other]), pa.array(x[other])], ["region", "x"])

    ordered = members.repartition("key").sortWithinPartitions("key", "x")
    others = materialize(map_batches(ordered, run, "region long, x long").distinct(), "regions")  # read twice
    return others.unionByName(others.select("region", F.col("region").alias("x")).distinct())


def sketches(values: np.ndarray, sizes: np.ndarray, least: int) -> list[bytes]:
    """Counts of every set in hash buckets, a power of two times ``least``, one byte each."""
    buckets = least << np.ceil(np.log2(np.maximum(sizes / (4 * least), 1))).astype(np.int64)
    first = np.cumsum(buckets) - buckets
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = first[row] + (values & (buckets[row] - 1).astype(U64)).astype(np.int64)
    flat = np.minimum(np.bincount(place, minlength=int(buckets.sum())), 255).astype(np.uint8).tobytes()
    return [flat[a:a + n] for a, n in zip(first.tolist(), buckets.tolist(), strict=True)]


def folded(given: list[bytes], buckets: int) -> np.ndarray:
    """Sketches as one matrix with ``buckets`` columns; larger ones are folded, which keeps the bound."""
    out = np.empty((len(given), buckets), dtype=np.int32)
    size = np.fromiter(map(len, given), dtype=np.int64, count=len(given))
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        own = np.frombuffer(b"".join(given[i] for i in some), np.uint8).reshape(len(some), n // buckets, buckets)
        out[some] = own.sum(axis=1, dtype=np.int32)
    return out


def cells(members: DataFrame, how: JaccardJoin) -> DataFrame:
    """(x, p): members of (region, x, n, counts) and the closest pivot of their region
    within the radius (step 3). Rows are streamed; only the region's pivots are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivots, kept, sizes = None, [], [], []
        for batch in batches:
            region, x, n = (batch.column(i).to_numpy() for i in range(3))
            given = batch.column(3).to_pylist()
            out_x, out_p = [], []
            begin = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else []
            for a, b in zip(begin, [*begin[1:], len(region)], strict=True):
                if current != region[a]:
                    current, pivots, kept, sizes = region[a], [], [], []
                whole, own = np.arange(a, b), given[a:b]
                width = min(map(len, [*own, *kept]))
                counts, old = folded(own, width), folded(kept, width)
                closest, owner = np.full(b - a, np.inf), np.full(b - a, -1)
                done, begun = 0, 0
                while True:
                    for j in range(done, len(pivots)):
                        apart = np.abs(counts[begun:] - old[j]).sum(axis=1)
                        within = apart <= how.radius(n[whole[begun:]], sizes[j])
                        better = np.flatnonzero(within & (apart < closest[begun:])) + begun
                        closest[better], owner[better] = apart[better - begun], j
                    done = len(pivots)
                    free = np.flatnonzero(owner[begun:] < 0)
                    if not len(free):
                        break
                    begun += int(free[0])
                    owner[begun] = len(pivots)
                    closest[begun] = -1
                    pivots.append(x[whole[begun]])
                    kept.append(own[begun])
                    old = np.concatenate([old, counts[begun:begun + 1]])
                    sizes.append(n[whole[begun]])
                    begun += 1
                p = np.array(pivots)[owner]
                keep = p != x[whole]
                out_x.append(x[whole][keep])
                out_p.append(p[keep])
            if out_x:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_x)), pa.array(np.concatenate(out_p))],
                                                 ["x", "p"])

    ordered = members.repartition("region").sortWithinPartitions("region", "x")
    return map_batches(ordered.select("region", "x", "n", "counts"), run, "x long, p long").distinct()


def across(members: DataFrame, how: JaccardJoin) -> DataFrame:
    """(x, p): pairs in one region of (region, x, far, component, n, counts), of different
    components and not excluded by the bound, one of them beyond the region's largest
    component (step 4). Only those members are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            region, x, far, component, n = (batch.column(i).to_numpy() for i in range(5))
            given = batch.column(5).to_pylist()
            begin = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else []
            for a, b in zip(begin, [*begin[1:], len(region)], strict=True):
                if current != region[a]:
                    current, held = region[a], []
                held += [(x[i], component[i], n[i], given[i]) for i in range(a, b) if far[i]]
                width = min(map(len, [*given[a:b], *(h[3] for h in held)]))
                counts, old = folded(given[a:b], width), folded([h[3] for h in held], width)
                for (hx, hc, hn, _), hs in zip(held, old, strict=True):
                    some = np.arange(a, b)
                    some = some[(component[some] != hc) & ((far[some] == 0) | (x[some] > hx))]
                    near = np.abs(counts[some - a] - hs).sum(axis=1) <= how.radius(n[some], hn)
                    if near.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.maximum(x[some[near]], hx)), pa.array(np.minimum(x[some[near]], hx))],
                            ["x", "p"])

    ordered = members.repartition("region").sortWithinPartitions("region", F.col("far").desc(), "x")
    return map_batches(ordered.select("region", "x", "far", "component", "n", "counts"), run,
                       "x long, p long").distinct()


def overlap(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Intersection and union sizes of the shingle sets of two text columns, row by row."""
    a, ra, na = shingle_sets(left, size)
    b, rb, nb = shingle_sets(right, size)
    values, rows = np.concatenate([a, b]), np.concatenate([ra, rb])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    both = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
    inter = np.bincount(rows[1:][both], minlength=len(na))
    return inter, na + nb - inter


def verified(pairs: DataFrame, docs: DataFrame, how: JaccardJoin) -> DataFrame:
    """The linked ones of the pairs (x, p), from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_x"):
                for some in pieces(part, "text_p"):
                    inter, union = overlap(some.column("text_x"), some.column("text_p"), how.size)
                    near = np.flatnonzero(100 * inter >= how.percent * union)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("x").take(near), some.column("p").take(near)], ["x", "p"])

    texts = pairs.join(docs.select(F.col("id").alias("x"), F.col("text").alias("text_x")), "x")
    texts = texts.join(docs.select(F.col("id").alias("p"), F.col("text").alias("text_p")), "p")
    return map_batches(texts.select("x", "p", "text_x", "text_p"), run, "x long, p long")


def one_document(classes: DataFrame) -> DataFrame:
    """(x, p): links that hold the rows of a repeated id together, where their sets have different names."""
    several = classes.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("id")
    return materialize(classes.join(several, "id").filter("rep <> id").select(
        F.col("id").alias("x"), F.col("rep").alias("p")).distinct(), "links")


def jaccard_components(docs: DataFrame, how: JaccardJoin = JaccardJoin(), *, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(signed(docs, how), "shingle-sets")
    same = ["n", "h1", "h2"]
    reps = sets.filter("n > 0").groupBy(*same).agg(F.min("id").alias("rep"))
    classes = materialize(sets.select("id", *same).join(reps, same, "left").select(
        "id", *same, F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "classes")
    given = classes.filter("n > 0 AND rep = id").select("id", *same).distinct()
    whole = sets.join(given, ["id", *same]).dropDuplicates(["id", *same])  # an id has a row for each of its texts
    keyed = whole.select(F.explode("keys").alias("key"), F.col("id").alias("x"))
    sketch = sets.select(F.col("id").alias("x"), *same, "counts").dropDuplicates(["x", *same]).drop("h1", "h2")
    members = materialize(named_regions(keyed).join(sketch, "x"), "members")

    pairs = materialize(cells(members, how), "pairs")
    links = materialize(verified(pairs, docs, how), "links").unionByName(one_document(classes))
    found = components(links, "x", "p")
    named = members.join(found.withColumnRenamed("node", "x"), "x", "left").withColumn(
        "component", F.coalesce("component", "x"))
    # a region's largest component; regions of one component are done
    largest = named.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(
        F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    left = named.join(largest.select("region", F.col("most.component").alias("main")), "region").withColumn(
        "far", F.when(F.col("component") == F.col("main"), 0).otherwise(1))
    more = materialize(across(left, how).join(pairs, ["x", "p"], "left_anti"), "pairs")
    links = links.unionByName(materialize(verified(more, docs, how), "links"))
    found = components(links, "x", "p")
    found = found.select(F.col("node").alias("rep"), "component")
    return classes.join(found, "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"))
