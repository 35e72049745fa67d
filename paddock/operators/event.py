"""Event block: entries of one event compared with each other.

P10 non-starter filter, J1/J2 fact joins, P11 start features, W1/W2 event
extremes, P12/P13 pace, J3 team-mate values, P14 team-mate delta, P15
head-to-head.

Event-wide extremes are computed with ``groupBy(event)`` (map-side partial
aggregation, so a hot event never lands whole in one task) and joined back;
the event table is tiny and is broadcast when Spark's size statistics allow.
Team-mate values come from partially aggregated first/second values per
(event, team), never a self-join and never a window over a whole team.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import non_starter
from ..session import materialize
from ..spec import PanelSpec, Params

DEFAULT_SPEC = PanelSpec()


def drop_non_starters(results: DataFrame, spec: PanelSpec = DEFAULT_SPEC,
                      observe_name: str | None = None) -> DataFrame:
    """Remove did-not-start rows (P10). With ``observe_name`` the number of
    removed rows is reported through ``DataFrame.observe`` (no extra job)."""
    flag = non_starter(spec.status)
    if observe_name:
        results = results.observe(observe_name, F.sum(flag.cast("bigint")).alias("removed_rows"))
    return results.filter(~flag)


def attach_facts(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                 spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """results LEFT JOIN qualifying LEFT JOIN sprints on (event, entity)."""
    keys = [spec.event, spec.entity]
    return results.join(qualifying, keys, "left").join(sprints, keys, "left")


def start_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """qualifying position falls back to the start rank; penalty delta."""
    qpos = F.coalesce(F.col("qualifying_pos"), F.col(spec.start))
    return df.withColumn("qualifying_pos", qpos).withColumn(
        "grid_penalty_delta", F.col(spec.start) - F.col("qualifying_pos"))


def _pct_delta(x, ref) -> F.Column:
    return F.try_divide(x - ref, ref) * F.lit(100.0)


def event_extremes(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per event: fastest and slowest trial time (W1, W2) as a small table."""
    t = F.col(spec.trial_time)
    return df.groupBy(spec.event).agg(F.min(t).alias("_pole"), F.max(t).alias("_slowest"))


def peer_first_values(df: DataFrame, cols: list[str], spec: PanelSpec = DEFAULT_SPEC,
                      suffix: str = "_tm", method: str = "aggregate") -> DataFrame:
    """First non-null value of each column among the *other* members of the
    same (event, team), in entry order (J3, Q9: chosen per column).

    ``aggregate`` (default): per (event, team) and column, the first and the
    second non-null (order key, value) are found with two partially
    aggregated ``min`` passes; a row takes the second when it is itself the
    first. Nothing is ever grouped by raw rows, so a huge team-in-event
    splits across tasks. Only rows up to the second lowest outcome can be
    first or second: two hashed ``min`` of the outcome alone, which sort
    nothing, name these rows before whole keys are compared. The values found
    are written, one row a team-in-event. ``window``: the same through two ordered frames
    (preceding, then following members) over (event, team).
    """
    key = [spec.event, spec.team]
    if method == "window":
        order = [F.col(spec.outcome).asc_nulls_last(), F.col(spec.entity).asc_nulls_last()]
        w = Window.partitionBy(*key).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        after = w.rowsBetween(1, Window.unboundedFollowing)
        out = df
        for c in cols:
            out = out.withColumn(c + suffix, F.coalesce(F.first(c, ignorenulls=True).over(before),
                                                        F.first(c, ignorenulls=True).over(after)))
        return out

    def ord_struct(c):
        # entry order with nulls last, then the value; null when value is null
        o, e = F.col(spec.outcome), F.col(spec.entity)
        return F.when(F.col(c).isNotNull(), F.struct(
            o.isNull().alias("o_null"), o.alias("o"), e.isNull().alias("e_null"), e.alias("e"),
            F.col(c).alias("v")))

    o, n = F.col(spec.outcome), range(len(cols))
    rows = df.select(*dict.fromkeys([*key, spec.outcome, spec.entity, *cols]))
    lowest = materialize(rows.groupBy(*key).agg(*[
        F.min(F.when(F.col(c).isNotNull(), o)).alias(f"_m1_{i}") for i, c in enumerate(cols)]), "lowest-outcomes")
    next_lowest = materialize(rows.join(lowest, key).groupBy(*key).agg(*[
        F.min(F.when(F.col(c).isNotNull() & (o > F.col(f"_m1_{i}")), o)).alias(f"_m2_{i}") for i, c in enumerate(cols)]),
        "next-outcomes")
    # without a second outcome all rows tie or have none
    near = [F.when(F.col(f"_m2_{i}").isNull() | (o <= F.col(f"_m2_{i}")), ord_struct(c)) for i, c in enumerate(cols)]
    tagged = rows.join(next_lowest, key).select(*key, *[s.alias(f"_s_{i}") for i, s in enumerate(near)]).filter(
        reduce(Column.__or__, [F.col(f"_s_{i}").isNotNull() for i in n]))
    first = tagged.groupBy(*key).agg(*[F.min(f"_s_{i}").alias(f"_p1_{i}") for i in n])
    second = tagged.join(first, key).groupBy(*key).agg(*[
        F.min(F.when(F.col(f"_s_{i}") != F.col(f"_p1_{i}"), F.col(f"_s_{i}"))).alias(f"_p2_{i}") for i in n])
    peers = materialize(first.join(second, key).select(*key, *[f"_p1_{i}" for i in n], *[
        F.col(f"_p2_{i}")["v"].alias(f"_p2_{i}") for i in n]), "peer-values")
    out = df.join(peers, key, "left")
    for i, c in enumerate(cols):
        own = ord_struct(c)
        p1, p2 = F.col(f"_p1_{i}"), F.col(f"_p2_{i}")
        is_self = own.isNotNull() & p1.eqNullSafe(own)
        out = out.withColumn(c + suffix, F.when(is_self, p2).otherwise(p1["v"]))
    return out.drop(*[f"_p{k}_{i}" for k in (1, 2) for i in range(len(cols))])


def pace_features(df: DataFrame, params: Params = Params(),
                  spec: PanelSpec = DEFAULT_SPEC, source: DataFrame | None = None) -> DataFrame:
    """Pace vs pole (P12), team-mate values (J3), fill chain (P13),
    team-mate delta (P14) and head-to-head outcome (P15).

    ``source`` (default ``df``) is the table the event extremes are taken
    from; pass the short-lineage entries table when ``df`` is a long chain.
    """
    t = spec.trial_time
    ext = materialize(event_extremes(source if source is not None else df, spec), "event-extremes")
    df = df.join(ext, spec.event, "left").withColumn("pace_delta_pct", _pct_delta(F.col(t), F.col("_pole")))
    # slowest pace of the event before filling; (x - p) / p * 100 is monotone
    # in x for a positive pole, so it is the pace of the slowest time.
    race_max = _pct_delta(F.col("_slowest"), F.col("_pole"))
    df = peer_first_values(df, [t, "pace_delta_pct", spec.outcome], spec)
    margin = F.lit(params.pace_margin)
    df = df.withColumn(
        "pace_delta_pct",
        F.coalesce(F.col("pace_delta_pct"), F.col("pace_delta_pct_tm") + margin,
                   race_max + margin, F.lit(params.pace_fill)))
    own, mate = F.col(t), F.col(t + "_tm")
    fill = F.lit(params.teammate_delta_fill)
    df = df.withColumn(
        "teammate_delta_pct",
        F.when(own.isNull() & mate.isNotNull(), fill)
        .when(own.isNotNull() & mate.isNull(), -fill)
        .otherwise(F.coalesce(_pct_delta(own, mate), F.lit(0.0))))
    pos, pos_tm = F.col(spec.outcome), F.col(spec.outcome + "_tm")
    cutoff = F.lit(params.h2h_cutoff)
    df = df.withColumn(
        "h2h_win",
        F.when((pos > cutoff) & (pos_tm > cutoff), F.lit(0.5))
        .otherwise(F.coalesce(pos < pos_tm, F.lit(False)).cast("double")))
    return df.drop("_pole", "_slowest")
