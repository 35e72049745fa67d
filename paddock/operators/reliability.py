"""Reliability block: rolling failure rates (W8-W11) and venue rate.

``rows`` mode keeps the reference's semantics: the mean failure flag of the
previous N *rows* of the key in entry order, so entries of the same event
that come earlier (team-mates) are visible (Q3). ``events`` mode is the
leak-free variant: the previous N *events* of the key, whole.

Neither mode runs a window over all rows of a key: a team or supplier key can
hold a large share of the panel. Both start from a pre-aggregate per (key,
event) — one row per event the key took part in — and run the ordered
window there. ``rows`` mode then places each row by its index within the key
(events before + position inside the event, from the skew-safe
``distributed_rank``) and takes the difference of two prefix sums; the far
end of the frame is an equi-join on (key, index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import distributed_rank
from ..spec import PanelSpec, Params

DEFAULT_SPEC = PanelSpec()


def _event_cols(spec: PanelSpec) -> list[str]:
    return [spec.period, spec.seq, spec.event]


def _per_key_event(df: DataFrame, keys: list[str], flag: str, spec: PanelSpec) -> DataFrame:
    return df.groupBy(*keys, *_event_cols(spec)).agg(
        F.sum(F.col(flag).cast("bigint")).alias("_ev_sum"), F.count(F.lit(1)).alias("_ev_n"))


def rolling_prior_rate(source: DataFrame, keys: list[str], flag: str, out: str,
                       params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                       mode: str | None = None) -> DataFrame:
    """Mean of ``flag`` over the previous ``reliability_window`` rows/events of ``keys``.

    Returns a narrow table (event, entity, out); null when the key has no
    history (callers fill). ``source`` needs keys, period, seq, event,
    outcome, entity and the flag.
    """
    mode = mode or params.reliability_mode
    n = params.reliability_window
    cols = list(dict.fromkeys([*keys, spec.period, spec.seq, spec.event, spec.outcome, spec.entity, flag]))
    src = source.select(*cols)
    ev = _per_key_event(src, keys, flag, spec)
    kw = Window.partitionBy(*keys).orderBy(spec.period, spec.seq)
    if mode == "events":
        frame = kw.rowsBetween(-n, -1)
        rates = ev.select(
            *keys, spec.event,
            F.try_divide(F.sum("_ev_sum").over(frame).cast("double"),
                         F.sum("_ev_n").over(frame).cast("double")).alias(out))
        return src.join(rates, [*keys, spec.event], "left").select(spec.event, spec.entity, out)
    if mode != "rows":
        raise ValueError(f"unknown reliability mode {mode!r}")

    # rows before this event, and failures before this event, per key
    before = kw.rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.select(*keys, spec.event,
                   F.coalesce(F.sum("_ev_n").over(before), F.lit(0)).alias("_rows_before"),
                   F.coalesce(F.sum("_ev_sum").over(before), F.lit(0)).alias("_sum_before"))
    # position and running failure count inside (key, event), in entry order,
    # without a window over the rows of a (key, event)
    x = F.col(flag).cast("bigint")
    rows = distributed_rank(src.withColumn("_x", x), [*keys, spec.event],
                            [(spec.outcome, True), (spec.entity, True)], "_pos", cumulative=("_x", "_cum"))
    rows = rows.join(ev, [*keys, spec.event], "left") \
        .withColumn("_idx", F.col("_rows_before") + F.col("_pos")) \
        .withColumn("_prefix", F.col("_sum_before") + F.col("_cum"))
    # prefix at index i - n - 1 (the row just outside the frame)
    far = rows.select(*[F.col(k) for k in keys], (F.col("_idx") + n + 1).alias("_idx"),
                      F.col("_prefix").alias("_prefix_far"))
    rows = rows.join(far, [*keys, "_idx"], "left")
    cnt = F.least(F.col("_idx") - 1, F.lit(n))
    total = (F.col("_prefix") - F.col("_x")) - F.coalesce(F.col("_prefix_far"), F.lit(0))
    return rows.select(spec.event, spec.entity,
                       F.when(cnt > 0, total.cast("double") / cnt.cast("double")).alias(out))


def entity_prior_rate(df: DataFrame, keys: list[str], flag: str, out: str,
                      params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows-mode rate for keys that contain the entity (one row per event):
    a plain bounded window, since an entity's history is bounded by the
    number of events it entered."""
    w = Window.partitionBy(*keys).orderBy(
        spec.period, spec.seq, F.col(spec.outcome).asc_nulls_last(), F.col(spec.entity).asc_nulls_last())
    return df.withColumn(out, F.avg(F.col(flag).cast("double")).over(
        w.rowsBetween(-params.reliability_window, -1)))


def reliability_features(df: DataFrame, params: Params = Params(),
                         spec: PanelSpec = DEFAULT_SPEC, source: DataFrame | None = None) -> DataFrame:
    """W8 entity, W9 team, W10 entity-team, W11 supplier failure rates.

    Each rate is computed on a narrow projection of ``source`` (default
    ``df``) and joined back on (event, entity).
    """
    src = source if source is not None else df
    return key_rates(entity_team_rate(entity_rate(df, params, spec), params, spec), src, params, spec)


def entity_rate(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """W8 without its fill."""
    return entity_prior_rate(df, [spec.entity], "is_dnf", "driver_dnf_rate_10", params, spec)


def entity_team_rate(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """W10 without its fill."""
    return entity_prior_rate(df, [spec.entity, spec.team], "is_dnf", "driver_team_dnf_rate_10", params, spec)


def key_rates(df: DataFrame, src: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """W9 and W11 joined to rows that have W8 and W10, and the fills of all four."""
    fill = F.lit(params.dnf_rate_fill)
    # team and supplier keys can be hot: pre-aggregated / prefix-sum path
    for keys, out in (([spec.team], "constructor_dnf_rate_10"), ([spec.supplier], "pu_dnf_rate_10")):
        df = df.join(rolling_prior_rate(src, keys, "is_dnf", out, params, spec),
                     [spec.event, spec.entity], "left")
    return df.withColumn("driver_dnf_rate_10", F.coalesce("driver_dnf_rate_10", fill)) \
             .withColumn("constructor_dnf_rate_10", F.coalesce("constructor_dnf_rate_10", fill)) \
             .withColumn("driver_team_dnf_rate_10", F.coalesce("driver_team_dnf_rate_10", "driver_dnf_rate_10")) \
             .withColumn("pu_dnf_rate_10", F.coalesce("pu_dnf_rate_10", fill))


def venue_event_rate(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                     flag: str = "is_dnf", out: str = "circuit_dnf_rate_5yr") -> DataFrame:
    """Failure rate at the venue over the previous W periods, when at least
    ``venue_rate_min_rows`` rows exist, else the fill (A8). Small table keyed
    by (venue, period)."""
    per = df.groupBy(spec.venue, spec.period).agg(
        F.sum(F.col(flag).cast("bigint")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(spec.venue).orderBy(spec.period).rangeBetween(-params.venue_rate_window, -1)
    s, n = F.sum("_s").over(w), F.sum("_n").over(w)
    return per.select(
        spec.venue, spec.period,
        F.when(F.coalesce(n, F.lit(0)) >= params.venue_rate_min_rows, s.cast("double") / n.cast("double"))
        .otherwise(F.lit(params.dnf_rate_fill)).alias(out))
