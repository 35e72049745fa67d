"""Ranking metrics and strategy comparison.

All metrics are grouped queries: one row per strategy, no driver loops.
Predictions are positions (1 = best); a strategy is any position column.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import points_of, relevance_of
from ..operators.venue import spearman
from ..spec import PanelSpec, Params

DEFAULT_SPEC = PanelSpec()


def rank_within(df: DataFrame, score: str, out: str, spec: PanelSpec = DEFAULT_SPEC,
                ascending: bool = False, skew_safe: bool = False) -> DataFrame:
    """Rank per event; ties share the lowest rank number.

    Null scores rank last (the reference raises on them). ``skew_safe``
    computes the same ranks without a window over a whole event (for events
    holding a large share of the rows).
    """
    if skew_safe:
        from ..functions.ranking import distributed_rank
        return distributed_rank(df, [spec.event], [(score, ascending)], out)
    o = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.withColumn(out, F.rank().over(Window.partitionBy(spec.event).orderBy(o)).cast("bigint"))


def chrono_split(df: DataFrame, test_period: int, spec: PanelSpec = DEFAULT_SPEC,
                 train_until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """train = period < cut (or < train_until), test = period == test_period."""
    cut = train_until if train_until is not None else test_period
    return (df.filter(F.col(spec.period) < F.lit(cut)),
            df.filter(F.col(spec.period) == F.lit(test_period)))


def split_profile(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, flag: str = "is_classified") -> DataFrame:
    """min/max period, distinct events, rows and failure share of a split."""
    return df.agg(
        F.min(spec.period).alias("min_period"), F.max(spec.period).alias("max_period"),
        F.countDistinct(spec.event).alias("events"), F.count(F.lit(1)).alias("rows"),
        F.avg(F.lit(1.0) - F.col(flag).cast("double")).alias("dnf_rate"))


def to_long(df: DataFrame, strategies: Mapping[str, str] | list[str], spec: PanelSpec = DEFAULT_SPEC,
            target: str | None = None) -> DataFrame:
    """(event, entity, target, strategy, pred) — one row per entry and strategy."""
    target = target or spec.outcome
    if not isinstance(strategies, Mapping):
        strategies = {c: c for c in strategies}
    structs = [F.struct(F.lit(name).alias("strategy"), F.col(col).cast("double").alias("pred"))
               for name, col in strategies.items()]
    return df.select(spec.event, spec.entity, F.col(target).cast("double").alias("target"),
                     F.explode(F.array(*structs)).alias("_s")) \
             .select(spec.event, spec.entity, "target", "_s.strategy", "_s.pred")


def expected_points_error(target: Column, pred: Column) -> Column:
    """Absolute difference of championship points of true and predicted
    positions (positions truncated to integers; null -> 0 points) (A9)."""
    return F.abs(points_of(target) - points_of(pred))


def rank_metrics(long: DataFrame, spec: PanelSpec = DEFAULT_SPEC, group: str = "strategy",
                 skew_safe: bool = False) -> DataFrame:
    """Metric bundle per strategy (A9-A12, A14): exp_pts_err, p1_acc,
    top3_acc, top10_acc, spearman_rho (mean per event, undefined skipped,
    0 when none), mae (mean per event of the mean absolute error).
    Per-event correlations rank with one window per (strategy, event) unless
    ``skew_safe``."""
    t, p = F.col("target"), F.col("pred")

    def hits(k):
        return F.sum(((t <= k) & (p <= k)).cast("bigint"))

    flat = long.groupBy(group).agg(
        F.countDistinct(spec.event).alias("events"),
        F.avg(expected_points_error(t, p)).alias("exp_pts_err"),
        F.sum(((t == 1) & (p == 1)).cast("bigint")).alias("_p1"),
        hits(3).alias("_top3"), hits(10).alias("_top10"))
    rho = spearman(long, [group, spec.event], "target", "pred", "_rho", skew_safe=skew_safe) \
        .groupBy(group).agg(F.avg("_rho").alias("spearman_rho"))
    mae = long.groupBy(group, spec.event).agg(F.avg(F.abs(t - p)).alias("_mae")) \
        .groupBy(group).agg(F.avg("_mae").alias("mae"))
    ev = F.col("events").cast("double")

    def pct(num, k):
        return F.when(ev > 0, F.col(num).cast("double") / (ev * k) * 100.0).otherwise(F.lit(0.0))

    return flat.join(rho, group, "left").join(mae, group, "left").select(
        group, "events", "exp_pts_err",
        pct("_p1", 1).alias("p1_acc"), pct("_top3", 3).alias("top3_acc"), pct("_top10", 10).alias("top10_acc"),
        F.coalesce("spearman_rho", F.lit(0.0)).alias("spearman_rho"),
        F.coalesce("mae", F.lit(0.0)).alias("mae"))


def compare_strategies(df: DataFrame, strategies: Mapping[str, str], spec: PanelSpec = DEFAULT_SPEC,
                       skew_safe: bool = False) -> DataFrame:
    """One metric row per strategy column (M8)."""
    return rank_metrics(to_long(df, strategies, spec), spec, skew_safe=skew_safe)


def ndcg_at_k(df: DataFrame, score: str, ks=(1, 3, 10), spec: PanelSpec = DEFAULT_SPEC,
              label: Column | None = None) -> DataFrame:
    """Mean NDCG@k over events; identity gain on relevance labels, log2
    discount; an event whose ideal DCG is 0 scores 1 (A13).

    Only the first max(k) rows of an event by score and by gain matter. Spark
    applies the rank limit before the shuffle as well, so an event of any
    size sends max(k) rows per task."""
    lab = label if label is not None else relevance_of(spec.outcome)
    rows = df.select(spec.event, spec.entity, F.col(score).alias("_score"), lab.cast("double").alias("_gain"))

    def dcg(order: Column, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(spec.event).orderBy(order, spec.entity))
        top = rows.withColumn("_rk", rank).filter(F.col("_rk") <= max(ks))
        return top.groupBy(spec.event).agg(*[
            F.sum(F.when(F.col("_rk") <= k, F.col("_gain") / F.log2(F.col("_rk") + 1.0)).otherwise(0.0))
            .alias(f"{name}{k}") for k in ks])

    per = dcg(F.col("_score").desc_nulls_last(), "_dcg").join(dcg(F.col("_gain").desc(), "_idcg"), spec.event)
    return per.agg(*[F.avg(F.when(F.col(f"_idcg{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_idcg{k}"))
                           .otherwise(1.0)).alias(f"ndcg_{k}") for k in ks])


def classification_accuracy(df: DataFrame, pred: str, truth: str = "is_classified") -> DataFrame:
    """Share of rows whose predicted flag equals the truth, in percent."""
    return df.agg((F.avg((F.col(pred).cast("bigint") == F.col(truth).cast("bigint")).cast("double"))
                   * 100.0).alias("accuracy"))


def baseline_predictions(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, skew_safe: bool = False) -> DataFrame:
    """Reference baselines: qualifying position as is; championship leader =
    rank by lagged points (W15)."""
    return rank_within(df, "driver_pts_lag", "championship_pred_pos", spec, skew_safe=skew_safe)
