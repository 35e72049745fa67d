"""Skew-safe ranks: rank() within a group, with large groups split.

``rank() OVER (PARTITION BY g ORDER BY k)`` puts every row of a group in one
task. ``distributed_ranks`` computes the same numbers for several groupings and
orders of one table at once and splits the groups of more than ``split_rows``
rows:

1. one grouped count over all groupings tells the large groups. Without any the
   ranks are plain windows and the table is read once;
2. one pass samples the order keys of the large groups by hash, about
   ``BUCKETS`` a group and order: the bounds, a written table;
3. one projection gives each row its bucket in every order (the number of
   bounds below its key), and one grouped count over it the rows before each
   bucket: the offsets, a written table;
4. every rank's window runs per (group, bucket) and its offset is added.

The result's plan reads the table once, whatever the number of ranks. Steps 1
to 3 run when the plan is built, so the table should be cheap to read (a
written one). Bounds are written, so a recomputed task sees the same buckets.
Large groups are known by two 64-bit hashes of their values, nulls included.

Ties share a key, hence a bucket, and the lowest rank, as with ``rank()``;
with a unique order key it equals ``row_number()``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SPLIT_ROWS = 100_000
BUCKETS = 64
_HASHES = 1 << 30
_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


@dataclass(frozen=True)
class Rank:
    """``out`` = rank within ``group`` by ``order``, [(column, ascending)]; with ``total`` = (value, name) also
    ``name`` = sum of ``value`` over the rows of the group up to and including this order key. ``totals``: more such
    sums in the same window."""

    group: list[str]
    order: list[tuple[str, bool]]
    out: str
    total: tuple[str, str] | None = None
    totals: tuple[tuple[str, str], ...] = ()

    @property
    def sums(self) -> list[tuple[str, str]]:
        return [*([self.total] if self.total else []), *self.totals]


def _sorted(c: str, asc: bool):
    return F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last()


def _key(df: DataFrame, order: list[tuple[str, bool]]) -> Column | None:
    """A struct that sorts ascending as ``order`` does, nulls last; None when a
    descending column cannot be negated (such groups stay whole)."""
    parts = []
    for c, asc in order:
        kind = df.schema[c].dataType.typeName()
        value = F.col(c)
        if not asc:
            if kind.split("(")[0] not in _NUMERIC:
                return None
            value = F.col(c).cast("double")
            value = F.when(F.isnan(value), F.lit(float("-inf"))).otherwise(-value)
        parts += [F.col(c).isNull(), value]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _hashes(group: tuple[str, ...], number: int, suffix: str = "") -> list[Column]:
    """Two hashes that name a group of one grouping, nulls told from absent values."""
    parts = [c for g in group for c in (F.col(g), F.col(g).isNull())]
    return [F.xxhash64(F.lit(number), F.lit(salt), *parts).alias(f"_rank_{salt}{suffix}") for salt in ("h", "i")]


def _bounds_below(bounds: str, key: Column) -> Column:
    """The number of sorted bounds below the key, of the first 2,047: found by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(11))])
    return F.when(F.col(bounds).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        F.get(bounds, n + step - 1) < key, n + step).otherwise(n)))


def _window(rank: Rank, bucket: list[str]):
    return Window.partitionBy(*rank.group, *bucket).orderBy(*[_sorted(c, a) for c, a in rank.order])


def _add(df: DataFrame, rank: Rank, bucket: list[str]) -> DataFrame:
    w = _window(rank, bucket)
    df = df.withColumn(rank.out, F.rank().over(w).cast("bigint"))
    if rank.sums:
        upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({name: F.coalesce(F.sum(value).over(upto), F.lit(0)) for value, name in rank.sums})
    return df


def _large_groups(df: DataFrame, groups: list[tuple[str, ...]], split_rows: int) -> DataFrame:
    """(_rank_h, _rank_i, _rank_n) of the groups of more than ``split_rows`` rows, over all groupings."""
    named = F.explode(F.array(*[F.struct(*_hashes(g, i)) for i, g in enumerate(groups)]))
    return df.select(named.alias("_rank")).select("_rank.*").groupBy("_rank_h", "_rank_i").agg(
        F.count(F.lit(1)).alias("_rank_n")).filter(F.col("_rank_n") > split_rows)


def distributed_ranks(df: DataFrame, ranks: list[Rank], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``df`` with the columns of every rank."""
    keys = [_key(df, r.order) for r in ranks]
    groups = list(dict.fromkeys(tuple(r.group) for r, k in zip(ranks, keys, strict=True) if k is not None))
    large = materialize(_large_groups(df, groups, split_rows), "large-groups") if groups else None
    if large is None or large.isEmpty():
        for r in ranks:
            df = _add(df, r, [])
        return df
    split = [(n, r, k, groups.index(tuple(r.group))) for n, (r, k) in enumerate(zip(ranks, keys, strict=True))
             if k is not None]
    names = ["_rank_h", "_rank_i"]

    # bounds of every order of the large groups
    needed = dict.fromkeys(c for _, r, _, _ in split for c in [*r.group, *[o for o, _ in r.order]])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_rank_g"), *_hashes(g, i)) for i, g in enumerate(groups)]))
    rows = df.select(*needed, each.alias("_rank")).select(*needed, "_rank.*").join(large, names)
    rate = F.lit(BUCKETS * _HASHES).cast("double") / F.col("_rank_n")
    bounds = rows.groupBy(*names).agg(*[
        F.sort_array(F.collect_set(F.when(
            (F.col("_rank_g") == i) & (F.pmod(F.xxhash64(*r.group, *[c for c, _ in r.order]), F.lit(_HASHES)) < rate), k)))
        .alias(f"_rank_b{n}") for n, r, k, i in split])
    bounds = materialize(bounds, "rank-bounds")

    # buckets of every row, in one projection a grouping
    bucketed = df
    for i, group in enumerate(groups):
        mine = [(n, k) for n, _, k, g in split if g == i]
        some = bounds.select(F.col("_rank_h").alias(f"_rank_h{i}"), F.col("_rank_i").alias(f"_rank_i{i}"),
                             *[f"_rank_b{n}" for n, _ in mine])
        bucketed = bucketed.select("*", *_hashes(group, i, str(i))).join(some, [f"_rank_h{i}", f"_rank_i{i}"], "left")
        bucketed = bucketed.select("*", F.col(f"_rank_b{mine[0][0]}").isNotNull().alias(f"_rank_s{i}"), *[
            _bounds_below(f"_rank_b{n}", k).alias(f"_rank_k{n}") for n, k in mine]).drop(*[f"_rank_b{n}" for n, _ in mine])

    # rows and sums of the earlier buckets of every split group, in one table
    totals = [(f"{n}_{j}", value) for n, r, _, _ in split for j, (value, _) in enumerate(r.sums)]
    cells = F.explode(F.filter(F.array(*[F.struct(
        F.lit(n).alias("_rank_no"), F.col(f"_rank_h{i}").alias("_rank_h"), F.col(f"_rank_i{i}").alias("_rank_i"),
        F.col(f"_rank_k{n}").alias("_rank_k"), F.col(f"_rank_s{i}").alias("s")) for n, _, _, i in split]),
        lambda c: c["s"]))
    counted = bucketed.select(cells.alias("_rank"), *dict.fromkeys(v for _, v in totals)).groupBy(
        "_rank._rank_no", "_rank._rank_h", "_rank._rank_i", "_rank._rank_k").agg(
        F.count(F.lit(1)).alias("_rank_rows"), *[F.sum(v).alias(f"_rank_v{n}") for n, v in totals])
    before = Window.partitionBy("_rank_no", *names).orderBy("_rank_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counted.select(
        "_rank_no", *names, "_rank_k", F.sum("_rank_rows").over(before).alias("_rank_off"),
        *[F.sum(f"_rank_v{n}").over(before).alias(f"_rank_t{n}") for n, _ in totals]), "rank-offsets")

    for n, r, _, i in split:
        here = [f"_rank_h{i}", f"_rank_i{i}", f"_rank_k{n}"]
        sums = [f"_rank_t{n}_{j}" for j in range(len(r.sums))]
        mine = offsets.filter(F.col("_rank_no") == n).select(
            *[F.col(a).alias(b) for a, b in zip([*names, "_rank_k"], here, strict=True)], "_rank_off", *sums)
        bucketed = _add(bucketed, r, [f"_rank_k{n}"]).join(mine, here, "left")
        bucketed = bucketed.withColumn(r.out, F.col(r.out) + F.coalesce("_rank_off", F.lit(0)))
        bucketed = bucketed.withColumns({name: F.col(name) + F.coalesce(s, F.lit(0))
                                         for (_, name), s in zip(r.sums, sums, strict=True)})
        bucketed = bucketed.drop("_rank_off", *sums)
    for r, k in zip(ranks, keys, strict=True):
        if k is None:
            bucketed = _add(bucketed, r, [])
    added = [c for r in ranks for c in (r.out, *[name for _, name in r.sums])]
    return bucketed.select(*[c for c in df.columns if c not in added], *added)


def distributed_rank(df: DataFrame, group: list[str], order: list[tuple[str, bool]], out: str,
                     cumulative: tuple[str, str] | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``df`` with one rank; see ``distributed_ranks``."""
    return distributed_ranks(df, [Rank(group, order, out, cumulative)], split_rows)


def distributed_row_number(df: DataFrame, group: list[str], order: list[tuple[str, bool]], out: str,
                           split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``row_number()`` within ``group`` by ``order`` when the order key is
    unique within the group (e.g. ends in an entity id)."""
    return distributed_rank(df, group, order, out, split_rows=split_rows)
