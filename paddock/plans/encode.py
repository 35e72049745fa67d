"""Category columns as numbers: ordered target rates (P25).

A category's rate at an event is the mean outcome of its rows in strictly
earlier events, shrunk to the mean over all earlier rows:

    (sum_before + weight * prior) / (n_before + weight)

so neither the row's own outcome nor one of its event is seen. Counts and sums
are aggregated per (category, event) first; the running sums are over these
rows, so a category with any share of the rows is no large group. Columns of
any number of values become features in the same way at every size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PanelSpec

DEFAULT_SPEC = PanelSpec()


def _sums_before(df: DataFrame, keys: list[str], value: Column, spec: PanelSpec) -> DataFrame:
    """(keys, event, _n, _s): number and sum of the values of earlier events, per key."""
    per = df.groupBy(*keys, spec.event, spec.period, spec.seq).agg(
        F.count(value).alias("_c"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_v"))
    w = Window.partitionBy(*keys, spec.period).orderBy(spec.seq).rangeBetween(Window.unboundedPreceding, -1)
    inside = per.select(*keys, spec.event, spec.period, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c"),
                        F.coalesce(F.sum("_v").over(w), F.lit(0.0)).alias("_v"))
    # earlier periods: one row per key and period
    by_period = per.groupBy(*keys, spec.period).agg(F.sum("_c").alias("_pc"), F.sum("_v").alias("_pv"))
    far = Window.partitionBy(*keys).orderBy(spec.period).rangeBetween(Window.unboundedPreceding, -1)
    by_period = by_period.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(spec.period).alias("_period"),
                                 F.coalesce(F.sum("_pc").over(far), F.lit(0)).alias("_pc"),
                                 F.coalesce(F.sum("_pv").over(far), F.lit(0.0)).alias("_pv"))
    on = F.col(spec.period).eqNullSafe(F.col("_period"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return inside.join(by_period, on).select(
        *keys, spec.event, (F.col("_c") + F.col("_pc")).alias("_n"), (F.col("_v") + F.col("_pv")).alias("_s"))


def category_rates(df: DataFrame, cols: Sequence[str], value: Column, suffix: str = "rate", weight: float = 20.0,
                   fill: float = 0.5, until: int | None = None, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """``df`` with ``<column>__<suffix>`` for every column. Null values do not count; a null category is a
    category; ``fill`` is the prior of the first event. ``until``: outcomes of periods from there on count
    for nobody (a test split must not see its own)."""
    seen = value if until is None else F.when(F.col(spec.period) < until, value)
    seen = seen.cast("double")
    prior = _sums_before(df.withColumn("_all", F.lit(1)), ["_all"], seen, spec).select(
        F.col(spec.event).alias("_e"), F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(fill).alias("_prior"))
    out = df.join(prior, F.col(spec.event) == F.col("_e"), "left").drop("_e")
    for c in cols:
        sums = _sums_before(df.select(spec.event, spec.period, spec.seq, F.col(c).alias("_cat"), seen.alias("_seen")),
                            ["_cat"], F.col("_seen"), spec).withColumnRenamed(spec.event, "_e")
        on = F.col(c).eqNullSafe(F.col("_cat")) & (F.col(spec.event) == F.col("_e"))
        rate = (F.coalesce("_s", F.lit(0.0)) + weight * F.col("_prior")) / (F.coalesce("_n", F.lit(0)) + weight)
        out = out.join(sums, on, "left").withColumn(f"{c}__{suffix}", rate).drop("_cat", "_e", "_n", "_s")
    return out.drop("_prior")
