"""History block: standings and exponentially weighted form.

A1 team totals per event, W4/W5 lagged cumulative standings, ``ewma_prior``
(W3, W6, W7), W12 first round of a period, W13 decay factors, W16 the whole
decayed-form operator.

``ewma_prior`` reproduces ``shift(1).ewm(alpha, adjust=True,
ignore_na=False, min_periods=1).mean()``: for row t the weighted mean of all
earlier non-null values with weight (1-alpha)^(t-1-j). Trailing nulls scale
numerator and denominator alike, so the value at t equals the EWMA anchored
at the newest earlier non-null row. We compute that anchored value at every
non-null row with running sums of rebased weights (see ``ewma_prior``) and
carry the newest one forward with ``last(ignorenulls)``. Runs of nulls of any
length are exact; no Python runs per row, no arrays are built.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import SPLIT_ROWS, distributed_row_number
from ..session import materialize
from ..spec import PanelSpec, Params

DEFAULT_SPEC = PanelSpec()


def _block_size(beta: float) -> int:
    """Rows per block such that beta^-block stays below 1e100: weight times
    value is finite for any value up to 1e200."""
    if beta <= 0.0:
        return 1
    if beta >= 1.0:
        return 1 << 40
    return max(1, int(100.0 / -math.log10(beta)))


def ewma_prior(df: DataFrame, value: str, partition: list[str], order: list,
               alpha: float, out: str, skew_safe: bool = False, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Exponentially weighted mean of the *earlier* rows of each partition; see ``ewma_priors``."""
    return ewma_priors(df, {value: out}, partition, order, alpha, skew_safe, split_rows)


def ewma_priors(df: DataFrame, values: dict[str, str], partition: list[str], order: list, alpha: float,
                skew_safe: bool = False, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Exponentially weighted means of the *earlier* rows of each partition, {value column: output}, in two sorts.

    ``order`` must make rows unique within a partition. Null when no earlier
    non-null value exists. With ``skew_safe`` a grouped count runs when the plan
    is built, and histories of more than ``split_rows`` rows are spread over
    tasks (``_ewma_by_blocks``; ``order`` then names columns).

    Rows are numbered i within the partition and cut into blocks of B rows
    (B from ``_block_size``: the rebased weights beta^-offset stay finite).
    At a non-null row r of block b the EWMA anchored at r is

        (L_r + beta^B * T_{b-1}) / (LW_r + beta^B * TW_{b-1})

    with L/LW running sums of beta^-offset * x (resp. beta^-offset) inside
    the block and T/TW the totals of the previous block, which are L/LW at its
    last row. Older blocks weigh below beta^B, about 1e-100, relative to
    x_r, so the value is exact in double precision; each step is O(1) per
    row. The anchored value is carried forward to later rows. After the
    numbering every window is ordered by (block, number), so one sort serves
    all of them and all values.
    """
    if skew_safe and not df.groupBy(*partition).count().filter(F.col("count") > split_rows).isEmpty():
        for value, out in values.items():
            df = _ewma_by_blocks(df, value, partition, order, alpha, out, split_rows)
        return df
    beta = 1.0 - alpha
    bsz = _block_size(beta)
    idx, blk, off = "_ew_i", "_ew_b", "_ew_o"
    df = df.withColumn(idx, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) \
           .withColumn(blk, F.floor(F.col(idx) / F.lit(bsz))) \
           .withColumn(off, F.col(idx) - F.col(blk) * F.lit(bsz))
    in_block = Window.partitionBy(*partition, blk).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*partition).orderBy(blk, idx).rowsBetween(Window.unboundedPreceding, -1)
    xs = {out: F.col(value).cast("double") for value, out in values.items()}
    weight = F.pow(F.lit(beta), -F.col(off).cast("double"))
    sums = {}
    for i, x in enumerate(xs.values()):
        w = F.when(x.isNotNull(), weight).otherwise(F.lit(0.0))
        sums |= {f"_ew_w{i}": F.sum(w).over(in_block), f"_ew_xw{i}": F.sum(F.coalesce(x * w, F.lit(0.0))).over(in_block)}
    df = df.withColumns(sums)
    carry = F.lit(beta ** bsz) if bsz < (1 << 40) else F.lit(0.0)
    df = df.withColumns({f"{c}_t": F.coalesce(F.last(F.when(F.col(off) == F.lit(bsz - 1), F.col(c)), ignorenulls=True)
                                              .over(earlier), F.lit(0.0)) for c in sums})
    num, den = ([F.col(f"_ew_{c}{i}") + carry * F.col(f"_ew_{c}{i}_t") for i in range(len(xs))] for c in ("xw", "w"))
    df = df.withColumns({f"_ew_a{i}": F.when(x.isNotNull(), num[i] / den[i]) for i, x in enumerate(xs.values())})
    df = df.withColumns({out: F.last(f"_ew_a{i}", ignorenulls=True).over(earlier) for i, out in enumerate(xs)})
    return df.drop(idx, blk, off, *sums, *[f"{c}_t" for c in sums], *[f"_ew_a{i}" for i in range(len(xs))])


_SPLIT_BLOCK = 4_096


def _ewma_by_blocks(df: DataFrame, value: str, partition: list[str], order: list[str], alpha: float, out: str,
                    split_rows: int) -> DataFrame:
    """``ewma_prior`` with no window over a whole history.

    Weighted sums are combined as a monoid: the sums anchored at the end of block
    b are A_b = beta^(B-1) * T_b + beta^B * A_(b-1), where T_b totals the block.
    1. Rows get their place in the history by split ranks; the numbered rows are written.
    2. One grouped sum gives a row a block of at most 4,096 rows; the windows
       that scan A_b and the newest mean run over this table only.
    3. It is joined back, and the rows' windows run per block.
    """
    beta = 1.0 - alpha
    size = min(_block_size(beta), _SPLIT_BLOCK)
    flags = {f"_ew_n{i}": F.col(c).isNotNull() for i, c in enumerate(order)}  # nulls first, as in a plain window
    keys = [(k, True) for i, c in enumerate(order) for k in (f"_ew_n{i}", c)]
    rows = distributed_row_number(df.withColumns(flags), partition, keys, "_ew_i", split_rows)
    x = F.col(value).cast("double")
    rows = rows.drop(*flags).withColumn("_ew_b", F.floor((F.col("_ew_i") - 1) / F.lit(size)))
    weight = F.pow(F.lit(beta), -((F.col("_ew_i") - 1) % F.lit(size)).cast("double"))
    rows = materialize(rows.withColumn("_ew_w", F.when(x.isNotNull(), weight).otherwise(F.lit(0.0))).withColumn(
        "_ew_xw", F.coalesce(x * F.col("_ew_w"), F.lit(0.0))), "ewma-rows")
    sums = ("_ew_xw", "_ew_w")

    # the same sums over blocks: rebased inside runs of blocks, plus the run before
    blocks = rows.groupBy(*partition, "_ew_b").agg(*[F.sum(c).alias(c) for c in sums])
    step = beta ** size
    run = _block_size(step)
    blocks = blocks.withColumn("_ew_run", F.floor(F.col("_ew_b") / F.lit(run))).withColumn(
        "_ew_off", (F.col("_ew_b") % F.lit(run)).cast("double"))
    inside = Window.partitionBy(*partition, "_ew_run").orderBy("_ew_b").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*partition).orderBy("_ew_run").rangeBetween(-1, -1)
    history = Window.partitionBy(*partition).orderBy("_ew_b")
    carry = step ** run if run < (1 << 40) else 0.0
    for c in sums:
        blocks = blocks.withColumn("_ew_t", F.col(c) * F.pow(F.lit(step), -F.col("_ew_off")))
        total = F.sum("_ew_t").over(inside) + F.lit(carry) * F.coalesce(F.sum("_ew_t").over(before), F.lit(0.0))
        blocks = blocks.withColumn("_ew_a" + c, F.lit(beta ** (size - 1)) * F.pow(F.lit(step), F.col("_ew_off")) * total)
        blocks = blocks.withColumn("_ew_p" + c, F.lit(beta) * F.coalesce(F.lag("_ew_a" + c).over(history), F.lit(0.0)))
    newest = F.when(F.col("_ew_w") > 0, (F.col("_ew_xw") + F.col("_ew_p_ew_xw")) / (F.col("_ew_w") + F.col("_ew_p_ew_w")))
    blocks = blocks.withColumn("_ew_newest", newest).withColumn("_ew_carry", F.last("_ew_newest", ignorenulls=True).over(
        history.rowsBetween(Window.unboundedPreceding, -1)))
    side = blocks.select(*[F.col(c).alias(f"_ew_k{i}") for i, c in enumerate(partition)], F.col("_ew_b").alias("_ew_kb"),
                         *["_ew_p" + c for c in sums], "_ew_carry")
    same = F.col("_ew_b") == F.col("_ew_kb")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_ew_k{i}"))
    block = Window.partitionBy(*partition, "_ew_b").orderBy("_ew_i")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    num, den = (F.sum(c).over(so_far) + F.col("_ew_p" + c) for c in sums)
    joined = rows.join(side, same).withColumn("_ew_anchor", F.when(F.col("_ew_w") > 0, num / den))
    earlier = F.last("_ew_anchor", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1))
    kept = [c for c in df.columns if c != out]
    return joined.withColumn("_ew_out", F.coalesce(earlier, F.col("_ew_carry"))).select(*kept, F.col("_ew_out").alias(out))


def weekend_reward(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Sprint points null -> 0; total reward = points + sprint points."""
    return df.withColumn("sprint_points", F.coalesce(F.col("sprint_points"), F.lit(0.0))) \
             .withColumn("total_weekend_pts", F.col(spec.reward) + F.col("sprint_points"))


def team_event_totals(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC,
                      value: str = "total_weekend_pts") -> DataFrame:
    """Team reward per (period, seq, team); nulls skipped, all-null -> 0 (A1)."""
    return df.groupBy(spec.period, spec.seq, spec.team).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("team_total"))


def _lagged_running_sum(df: DataFrame, value: str, partition: list[str], order: list,
                        out: str) -> DataFrame:
    """Running sum, shifted by one row, 0 when absent.

    A null value leaves a null running total at its own row, so the next
    row's lag is 0 (the reference's cumsum-then-shift behaviour).
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    running = F.when(F.col(value).isNotNull(),
                     F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("_run", running) \
             .withColumn(out, F.coalesce(F.lag("_run", 1).over(w), F.lit(0.0))) \
             .drop("_run")


def driver_points_lag(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Entity's points before this event within the period."""
    # the entity first: rows sorted for the other windows of an entity's history need no other sort
    return _lagged_running_sum(df, "total_weekend_pts", [spec.entity, spec.period],
                               [spec.seq], "driver_pts_lag")


def team_points_lag(df: DataFrame, totals: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Team's points before this event within the period (A1 + W5)."""
    lagged = _lagged_running_sum(totals, "team_total", [spec.period, spec.team], [spec.seq],
                                 "team_pts_lag").drop("team_total")
    # written, so that its size is known and a small one is not met by a shuffle of all entries
    return df.join(materialize(lagged, "team-lags"), [spec.period, spec.seq, spec.team], "left")


def period_first_seq(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """First seq of every period present (W12) as a small table."""
    return df.groupBy(spec.period).agg(F.min(spec.seq).alias("_first_seq"))


def _ordered_bits(value: Column) -> Column:
    """A long for every double, in the same order (IEEE 754 bits, the negative ones turned round)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _double_of(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits if bits >= 0 else bits ^ ((1 << 63) - 1)))[0]


def global_median(df: DataFrame, col: str, params: Params, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Exact median of a column as a one-row table (A4; Q5 option as_of_period);
    nulls and NaN do not count, no value gives null.

    Selection by bits: the values' order-preserving 64-bit keys are counted by
    their leading 16 bits, then, among the keys that share these with a middle
    value, by the next 16, four times. Each step is a grouped count (combined
    before the shuffle) of at most two times 65,536 rows, which the driver
    reads; no window, no join, no task that holds the values. The distinct
    values are counted once and written, so a step reads a small table."""
    src = df
    if params.as_of_period is not None:
        src = src.filter(F.col(spec.period) < F.lit(params.as_of_period))
    value = F.col(col).cast("double")
    counts = materialize(src.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")).select(_ordered_bits(F.col("_v")).alias("_k"), "_c"), "value-counts")
    n = counts.agg(F.sum("_c")).first()[0]
    # the (n + 1) / 2-th and (n + 2) / 2-th values, rounded down: their leading bits so far and place among these
    middles = [(0, (n + 1) // 2), (0, (n + 2) // 2)] if n else []
    for level, shift in enumerate((48, 32, 16, 0)):
        if not middles:
            break
        some = counts.filter(F.shiftright("_k", shift + 16).isin([p for p, _ in middles])) if level else counts
        found = sorted(some.groupBy(F.shiftright("_k", shift).alias("_p")).agg(F.sum("_c").alias("_c")).collect(),
                       key=lambda r: r["_p"])
        nexts = []
        for prefix, place in middles:
            for r in found:
                if level and r["_p"] >> 16 != prefix:
                    continue
                if place <= r["_c"]:
                    nexts.append((r["_p"], place))
                    break
                place -= r["_c"]
        middles = nexts
    median = sum(_double_of(k) for k, _ in middles) / 2 if middles else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("_median"))


def raw_form(df: DataFrame, totals: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
             skew_safe: bool = False, more: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parameter-free part of the decayed form: raw EWMAs.

    Returns (rows with ``_drv_ewma_raw``, team table with ``_con_ewma_raw``).
    ``more``: other values of the entity's history to average in the same sorts, {column: output}.
    """
    order = [spec.period, spec.seq]
    rows = ewma_priors(df, {spec.outcome: "_drv_ewma_raw", **(more or {})}, [spec.entity], order, params.ewma_alpha,
                       skew_safe)
    teams = ewma_prior(totals, "team_total", [spec.team], order, params.ewma_alpha, "_con_ewma_raw", skew_safe)
    return rows, materialize(teams.select(spec.period, spec.seq, spec.team, "_con_ewma_raw"), "team-form")


def decay_factors(period: Column, seq: Column, first_seq: Column, params_cols: dict,
                  reset_periods) -> tuple[Column, list[Column]]:
    """Multiplicative decay for entity form and team form.

    Returns (entity factor, team factors); the team factors are applied one
    after another (period start, reset period start, summer round) as in the
    reference. ``params_cols`` maps decay names to columns or literals so the
    same expression serves one parameter set or a sweep table of many.
    """
    is_start = seq == first_seq
    in_reset = period.isin(list(reset_periods)) if reset_periods else F.lit(False)
    one = F.lit(1.0)
    drv = F.when(in_reset & is_start, params_cols["driver_reg_reset_decay"]).otherwise(one)
    con = [F.when(is_start, params_cols["off_season_decay"]).otherwise(one),
           F.when(is_start & in_reset, params_cols["regulation_reset_decay"]).otherwise(one),
           F.when(seq == params_cols["summer_break_round"], params_cols["summer_break_decay"]).otherwise(one)]
    return drv, con


def apply_factors(x: Column, factors: list[Column]) -> Column:
    for f in factors:
        x = x * f
    return x


def decayed_form(df: DataFrame, totals: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                 source: DataFrame | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Entity and team form with period-reset decay (W16 = W6+W7+W12+W13).

    ``source`` (default ``df``) feeds the global median and the first seq of
    each period. ``more``: see ``raw_form``."""
    src = source if source is not None else df
    rows, teams = raw_form(df, totals, params, spec, more=more)
    med = global_median(src, spec.outcome, params, spec).scalar()
    firsts = materialize(period_first_seq(src, spec), "first-seqs")
    rows = rows.join(teams, [spec.period, spec.seq, spec.team], "left") \
               .join(firsts, spec.period, "left").withColumn("_median", med)
    lits = {
        "driver_reg_reset_decay": F.lit(params.driver_reg_reset_decay),
        "off_season_decay": F.lit(params.off_season_decay),
        "regulation_reset_decay": F.lit(params.regulation_reset_decay),
        "summer_break_decay": F.lit(params.summer_break_decay),
        "summer_break_round": F.lit(params.summer_seq),
    }
    drv_f, con_f = decay_factors(F.col(spec.period), F.col(spec.seq), F.col("_first_seq"), lits,
                                 params.reset_periods)
    return rows.withColumn(
        "driver_form_ewma", F.coalesce(F.col("_drv_ewma_raw"), F.col("_median")) * drv_f
    ).withColumn(
        "constructor_form_ewma", apply_factors(F.coalesce(F.col("_con_ewma_raw"), F.lit(0.0)), con_f)
    ).drop("_drv_ewma_raw", "_con_ewma_raw", "_first_seq", "_median")


def h2h_form(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
             skew_safe: bool = False) -> DataFrame:
    """EWMA of earlier head-to-head outcomes per entity, fill 0.5."""
    return h2h_fill(ewma_prior(df, "h2h_win", [spec.entity], [spec.period, spec.seq], params.ewma_alpha,
                               "teammate_h2h_form", skew_safe), params)


def h2h_fill(df: DataFrame, params: Params = Params()) -> DataFrame:
    """The fill of ``h2h_form``, for a table that has the raw mean as ``teammate_h2h_form``."""
    return df.withColumn("teammate_h2h_form",
                         F.coalesce(F.col("teammate_h2h_form"), F.lit(params.h2h_fill)))
