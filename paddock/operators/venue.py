"""Venue block: Spearman correlation (A5) and venue rank retention.

Spearman = Pearson of average ranks over pairwise-complete rows. Ranks come
from the skew-safe ``distributed_ranks``, so no window ever spans a whole
large group; zero variance gives null (``try_divide``), never an error.

Retention for (venue, period T) uses the rows of that venue in periods
T-W..T-1. Values are ranked once a venue, with running counts by period, and
a row's rank in the window of each T that it serves is a difference of these:
rows are copied to their W targets only inside the final partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import Rank, distributed_ranks
from ..session import materialize
from ..spec import PanelSpec, Params

DEFAULT_SPEC = PanelSpec()


def _with_avg_ranks(pairs: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Average ranks per group of several columns at once, {column: output} (ties share the mean of
    their positions) = (rank + inclusive running count) / 2, from the skew-safe
    ``distributed_ranks``: no window spans a whole large group."""
    ranks = [Rank(keys, [(c, True)], f"_rk{i}", ("_one", f"_cum{i}")) for i, c in enumerate(cols)]
    ranked = distributed_ranks(pairs.withColumn("_one", F.lit(1)), ranks)
    return ranked.select(*pairs.columns, *[
        ((F.col(f"_rk{i}") + F.col(f"_cum{i}")).cast("double") / 2.0).alias(out) for i, out in enumerate(cols.values())])


def _with_avg_rank_window(pairs: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Same average rank with a running count over the distinct values of
    each group (one task per group): cheaper when groups are small."""
    vals = pairs.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = vals.withColumn(
        out, (F.sum("_cnt").over(w) - F.col("_cnt")).cast("double") + (F.col("_cnt") + 1) / 2.0).drop("_cnt")
    return pairs.join(ranked, [*keys, col])


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _rank_correlation(a: str, b: str) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, keys: list[str], a: str, b: str, out: str = "rho",
             n_out: str | None = None, skew_safe: bool = True) -> DataFrame:
    """Spearman rank correlation of ``a`` and ``b`` per group of ``keys``.

    Rows where either value is null (or NaN) are dropped first. Null when the
    group has fewer than two complete rows or either side is constant.
    ``skew_safe=False`` ranks with one window per group (small groups).
    """
    pairs = df.select(*keys, _clean(a).alias("_a"), _clean(b).alias("_b")) \
              .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    if skew_safe:
        ranked = _with_avg_ranks(pairs, keys, {"_a": "_ra", "_b": "_rb"})
    else:
        ranked = _with_avg_rank_window(_with_avg_rank_window(pairs, keys, "_a", "_ra"), keys, "_b", "_rb")
    aggs = [_rank_correlation("_ra", "_rb").alias(out)]
    if n_out:
        aggs.append(F.count(F.lit(1)).alias(n_out))
    # a lone pair has zero spread on both sides: undefined like pandas
    return ranked.groupBy(*keys).agg(*aggs)


def _past_windows(df: DataFrame, params: Params, spec: PanelSpec) -> DataFrame:
    """(venue, T) for every period T in which the venue appears, with the
    number of past rows and distinct past periods in T-W..T-1."""
    per = df.groupBy(spec.venue, spec.period).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(spec.venue).orderBy(spec.period).rangeBetween(-params.retention_window, -1)
    return per.select(
        spec.venue, spec.period,
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_past_rows"),
        F.count(F.lit(1)).over(w).alias("_past_periods"))


def _past_correlation(df: DataFrame, params: Params, spec: PanelSpec) -> DataFrame:
    """Spearman(start, outcome) over each venue's rows in T-W..T-1, per (venue, T)."""
    wlen, keys = params.retention_window, [spec.venue, "_side", "_value"]
    pairs = df.select(spec.venue, spec.period, _clean(spec.start).alias("_a"), _clean(spec.outcome).alias("_b")) \
        .dropna().filter(F.col(spec.period).isNotNull())
    periods = sorted(r[0] for r in pairs.select(spec.period).distinct().collect())
    # a row for every venue, side (start, outcome) and value: its rows up to each period
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_side"), F.col(c).alias("_value")) for i, c in enumerate("_a _b".split())]))
    values = pairs.select(spec.venue, spec.period, sides.alias("_s")).select(spec.venue, spec.period, "_s.*") \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
            F.count(F.when(F.col(spec.period) <= p, 1)).alias(f"_n{i}") for i, p in enumerate(periods)])
    ranked = distributed_ranks(materialize(values, "venue-values"), [Rank(
        keys[:2], [("_value", True)], "_rank", totals=tuple((f"_n{i}", f"_c{i}") for i in range(len(periods))))])
    # rows below a value plus half of those that equal it, up to each period: a window's average rank is a
    # difference of two, plus one half
    below = F.array(F.lit(0.0), *[F.col(f"_c{i}") - F.col(f"_n{i}") / F.lit(2.0) for i in range(len(periods))])
    for side, c in enumerate("ab"):
        table = ranked.filter(F.col("_side") == side).select(spec.venue, F.col("_value").alias(f"_{c}"), below.alias(f"_{c}s"))
        pairs = pairs.join(table, [spec.venue, f"_{c}"])
    # the windows: of every period, the places of its first and last past period
    windows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(sum(p < t - wlen for p in periods)).alias("lo"),
                                 F.lit(sum(p < t for p in periods)).alias("hi")) for t in periods or [0]])
    mine = F.filter(windows, lambda w: (w["t"] > F.col(spec.period)) & (w["t"] <= F.col(spec.period) + wlen))
    placed = pairs.select(spec.venue, "_as", "_bs", F.explode(mine).alias("_w")).select(
        spec.venue, F.col("_w.t").alias(spec.period), *[
            (F.get(f"_{c}s", F.col("_w.hi")) - F.get(f"_{c}s", F.col("_w.lo")) + F.lit(0.5)).alias(f"_r{c}") for c in "ab"])
    return placed.groupBy(spec.venue, spec.period).agg(_rank_correlation("_ra", "_rb").alias("_rho"))


def retention_inputs(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per (venue, period): past row count, past periods, past correlation."""
    past = _past_windows(df, params, spec)
    rho = _past_correlation(df, params, spec)
    return past.join(rho, [spec.venue, spec.period], "left")


def global_retention(per: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Mean of the defined past correlations with enough rows; fill when
    none (A7). One row, column ``global_retention``."""
    src = per
    if params.as_of_period is not None:
        src = src.filter(F.col(spec.period) < F.lit(params.as_of_period))
    return src.filter((F.col("_past_rows") >= params.retention_global_min_rows) & F.col("_rho").isNotNull()) \
        .agg(F.coalesce(F.avg("_rho"), F.lit(params.retention_fill)).alias("global_retention"))


def venue_retention(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rank retention per (venue, period) (A6) with the global mean.

    Output: venue, period, track_retention_idx, track_retention_confidence.
    The correlation table is computed once and used for both.
    """
    per = materialize(retention_inputs(df, params, spec), "retention-inputs")
    g = global_retention(per, params, spec).scalar()
    conf = F.least(F.col("_past_periods").cast("double") / F.lit(float(params.retention_window)), F.lit(1.0))
    raw = F.when(F.col("_past_rows") >= params.retention_min_rows, F.coalesce(F.col("_rho"), g)).otherwise(g)
    return per.select(
        spec.venue, spec.period,
        (conf * raw + (F.lit(1.0) - conf) * g).alias("track_retention_idx"),
        conf.alias("track_retention_confidence"))
