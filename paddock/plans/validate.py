"""Chronological validation (M4) and decay-parameter sweep.

The sweep splits the decayed form into its parameter-free part (raw EWMAs,
computed once) and per-period factors. An event's ranking depends on its
factors only, and few combinations differ in them, so entries are ranked once
per event and distinct set of factors; the errors are mapped back to the
combinations in the small event x grid table. ``sweep_models`` scores the
combinations by a fitted ranker instead, one fit per distinct training matrix.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from threading import Condition
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import distributed_rank
from ..functions.scalars import relevance_of
from ..operators import form as fm
from ..operators.venue import spearman
from ..session import materialize, scratch_path, storage_bytes
from ..sources.store import read_periods, write_periods
from ..spec import FEATURES, SWEEP_GRID, PanelSpec, Params
from .metrics import chrono_split, expected_points_error, rank_within
from .models import assemble, cached_row_bytes, pointwise_trees

DEFAULT_SPEC = PanelSpec()


# ---------------------------------------------------------------------------
# M4: expanding-window cross-validation

def chrono_cv(matrix: DataFrame, params: Params = Params(), features: Sequence[str] = FEATURES,
              spec: PanelSpec = DEFAULT_SPEC, ranker_kw: dict | None = None, skew_safe: bool = False,
              threads: int = 4) -> DataFrame:
    """For each validation period v: train on periods < v, score v.

    One row per fold: events, train_rows, val_rows, scored_rows, pace_rho
    (qualifying position vs outcome), model_rho, p1_acc, beats_baseline. The
    feature vectors are written once, by period; a fold reads the folders of
    its periods and writes no training set of its own. Folds are fitted side by
    side; all metrics are one grouped query over the union of the folds.
    """
    kw = dict(trees=100, rate=0.03, depth=4, min_rows=20)
    kw.update(ranker_kw or {})
    keys = [spec.event, spec.entity, spec.period, spec.outcome]
    given = assemble(matrix.withColumn("_pace", F.col("qualifying_pos").cast("double")).withColumn(
        "_label", F.log1p(relevance_of(spec.outcome).cast("double"))), features, keep=[*keys, "_pace", "_label"])
    path = scratch_path(matrix.sparkSession, "cv-features")
    write_periods(given, path, spec.period)
    data = read_periods(matrix.sparkSession, path, given.schema)

    def fold(v: int) -> DataFrame:
        train, val = chrono_split(data, v, spec)
        model = pointwise_trees(train.select("features", "_label"), params=params, **kw)
        scored = model.transform(val).withColumnRenamed("prediction", "_score")
        return rank_within(scored, "_score", "_pred", spec, skew_safe=skew_safe).select(
            F.lit(v).cast("bigint").alias("fold"), spec.event, spec.entity,
            F.col(spec.outcome).cast("double").alias("target"), F.col("_pace").alias("pace"),
            F.col("_pred").cast("double").alias("model"))

    with ThreadPoolExecutor(max_workers=threads) as pool:
        preds = list(pool.map(inheritable_thread_target(fold), params.validation_periods))
    allp = materialize(reduce(DataFrame.unionByName, preds), "cv-predictions")
    base = allp.groupBy("fold").agg(
        F.countDistinct(spec.event).alias("events"), F.count(F.lit(1)).alias("val_rows"),
        F.count("model").alias("scored_rows"),
        F.sum(((F.col("target") == 1) & (F.col("model") == 1)).cast("bigint")).alias("_p1"))
    sizes = data.groupBy(spec.period).agg(F.count(F.lit(1)).alias("_n"))
    before = reduce(DataFrame.unionByName, [
        sizes.filter(F.col(spec.period) < F.lit(v)).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("train_rows"))
        .select(F.lit(v).cast("bigint").alias("fold"), "train_rows") for v in params.validation_periods])

    def rho(col: str, out: str) -> DataFrame:
        return spearman(allp, ["fold", spec.event], "target", col, "_r", skew_safe=skew_safe).groupBy("fold") \
            .agg(F.avg("_r").alias(out))

    out = base.join(before, "fold").join(rho("pace", "pace_rho"), "fold", "left") \
        .join(rho("model", "model_rho"), "fold", "left").select(
        "fold", "events", "train_rows", "val_rows", "scored_rows",
        F.coalesce("pace_rho", F.lit(0.0)).alias("pace_rho"),
        F.coalesce("model_rho", F.lit(0.0)).alias("model_rho"),
        (F.col("_p1").cast("double") / F.col("events") * 100.0).alias("p1_acc"))
    return out.withColumn("beats_baseline", F.col("model_rho") > F.col("pace_rho"))


# ---------------------------------------------------------------------------
# Parameter grid as a table

def param_grid(spark: SparkSession, ranges: dict | None = None) -> DataFrame:
    """Cross product of the sweep ranges with a ``combo_id`` that follows
    parameter order (first parameter slowest) — the tie-break order."""
    gen, cols = grid_columns(ranges)
    return spark.range(1).select(gen).select(F.col("combo_id").cast("bigint"), *[c.alias(n) for n, c in cols.items()])


def grid_columns(ranges: dict | None = None) -> tuple:
    """(combo id generator, {name: value column}) for the grid: the id is
    exploded from ``sequence(0, n-1)`` and each parameter is decoded from it
    (mixed radix, first parameter slowest) through a small literal array."""
    ranges = ranges or SWEEP_GRID
    sizes = [len(v) for v in ranges.values()]
    total = 1
    for n in sizes:
        total *= n
    gen = F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("combo_id")
    cols = {}
    stride = total
    for (name, values), n in zip(ranges.items(), sizes):
        stride //= n
        i = (F.floor(F.col("combo_id") / F.lit(stride)) % F.lit(n)).cast("int")
        dtype = "bigint" if name == "summer_break_round" else "double"
        cols[name] = F.element_at(F.array(*[F.lit(v).cast(dtype) for v in values]), i + 1)
    return gen, cols


def sweep_inputs(entries: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                 up_to: int | None = None) -> DataFrame:
    """Parameter-free columns the sweep needs, per entry of the validation
    periods (or of all periods up to ``up_to``): raw entity/team EWMAs, median, first seq of the period."""
    totals = fm.team_event_totals(fm.weekend_reward(entries, spec), spec)
    rows, teams = fm.raw_form(entries, totals, params, spec)
    med = fm.global_median(entries, spec.outcome, params, spec).scalar()
    firsts = fm.period_first_seq(entries, spec)
    wanted = F.col(spec.period).isin(list(params.validation_periods)) if up_to is None \
        else F.col(spec.period) <= F.lit(up_to)
    return rows.filter(wanted) \
        .join(teams, [spec.period, spec.seq, spec.team], "left") \
        .join(firsts, spec.period, "left") \
        .select(spec.event, spec.entity, spec.period, spec.seq, spec.outcome, "_drv_ewma_raw", "_con_ewma_raw",
                "_first_seq", med.alias("_median"))


def event_factors(inputs: DataFrame, params: Params, spec: PanelSpec, ranges: dict | None) -> tuple[DataFrame, list[str]]:
    """The decay factors of every event and combination, without entries, and their column names: the first
    is the entity's, the others are the team's."""
    gen, pcols = grid_columns(ranges)
    events = inputs.select(spec.event, spec.period, spec.seq, "_first_seq").distinct()
    x = events.select("*", gen).select("*", *[c.alias(n) for n, c in pcols.items()])
    drv_f, con_f = fm.decay_factors(F.col(spec.period), F.col(spec.seq), F.col("_first_seq"),
                                    {k: F.col(k) for k in pcols}, params.reset_periods)
    names = ["_f0", *[f"_f{i + 1}" for i in range(len(con_f))]]
    return x.select("combo_id", spec.event, spec.period, *[
        c.cast("double").alias(n) for n, c in zip(names, [drv_f, *con_f], strict=True)]), names


def sweep_decay(entries: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                ranges: dict | None = None, skew_safe: bool = False) -> DataFrame:
    """Mean expected points error of every decay combination over the
    validation periods (M5, ``form`` scorer): entries are ranked per event by
    decayed team form minus decayed entity form. One row per combination."""
    spark = entries.sparkSession
    grid = param_grid(spark, ranges)
    inputs = materialize(sweep_inputs(entries, params, spec), "sweep-inputs")
    factors, names = event_factors(inputs, params, spec, ranges)
    variants = factors.select(spec.event, *names).distinct()
    # entries once per event and distinct set of factors
    score = fm.apply_factors(F.coalesce(F.col("_con_ewma_raw"), F.lit(0.0)), [F.col(n) for n in names[1:]]) \
        - F.coalesce("_drv_ewma_raw", "_median") * F.col("_f0")
    scored = inputs.join(variants, spec.event).select(spec.event, *names, spec.outcome, score.alias("_score"))
    if skew_safe:
        ranked = distributed_rank(scored, [spec.event, *names], [("_score", False)], "_pred")
    else:
        ranked = scored.withColumn("_pred", F.rank().over(
            Window.partitionBy(spec.event, *names).orderBy(F.desc("_score"))))
    errors = ranked.groupBy(spec.event, *names).agg(
        F.sum(expected_points_error(F.col(spec.outcome), F.col("_pred"))).alias("_err"),
        F.count(F.lit(1)).alias("_n"))
    folds = factors.join(errors, [spec.event, *names]).groupBy("combo_id", spec.period).agg(
        (F.sum("_err") / F.sum("_n")).alias("_err"))
    per = folds.groupBy(F.col("combo_id").cast("bigint").alias("combo_id")).agg(
        F.avg("_err").alias("mean_exp_pts_err"), F.count(F.lit(1)).alias("folds"))
    return grid.join(per, "combo_id", "inner")


FORMS = ("driver_form_ewma", "constructor_form_ewma")


def _classes(factors: DataFrame, names: list[str], folds: Sequence[int], spec: PanelSpec) -> DataFrame:
    """(fold, combo_id, rep, fitted): combinations whose factors agree at every event up to the fold's period have one
    training and validation matrix, and share the smallest id as ``rep``; those that agree at every earlier event have
    one training matrix, and share the smallest id as ``fitted``. They are found by two 64-bit sums of
    hashes over (event, factors), grouped, without comparing combinations. Folds without events are left out."""
    upto = factors.select("*", F.explode(F.array(*[F.lit(v).cast("bigint") for v in folds])).alias("fold")) \
        .filter(F.col(spec.period) <= F.col("fold"))
    first, second = F.xxhash64(spec.event, *names), F.xxhash64(F.lit("sum"), spec.event, *names).cast("decimal(20,0)")
    earlier = F.col("_since") < F.col("fold")
    signed = upto.groupBy("fold", "combo_id").agg(
        F.bit_xor(first).alias("_h"), F.sum(second).alias("_s"),
        F.bit_xor(F.when(earlier, first)).alias("_eh"), F.sum(F.when(earlier, second)).alias("_es"),
        F.max(spec.period).alias("_last")).filter(F.col("_last") == F.col("fold"))

    def smallest(*hashes: str) -> Column:
        return F.min(F.col("combo_id").cast("bigint")).over(Window.partitionBy("fold", *hashes))

    return signed.select("fold", F.col("combo_id").cast("bigint").alias("combo_id"), smallest("_h", "_s").alias("rep"),
                         smallest("_eh", "_es").alias("fitted"))


class Room:
    """Admits tasks side by side while their sizes sum up to ``limit`` at most; a larger one runs alone."""

    def __init__(self, limit: int):
        self.limit, self.held, self.turn = limit, 0, Condition()

    @contextmanager
    def of(self, size: int):
        size = min(size, self.limit)
        with self.turn:
            self.turn.wait_for(lambda: self.held + size <= self.limit)
            self.held += size
        try:
            yield
        finally:
            with self.turn:
                self.held -= size
                self.turn.notify_all()


def sweep_models(matrix: DataFrame, entries: DataFrame, params: Params = Params(), features: Sequence[str] = FEATURES,
                 spec: PanelSpec = DEFAULT_SPEC, ranges: dict | None = None, ranker_kw: dict | None = None,
                 skew_safe: bool = False, threads: int = 4) -> DataFrame:
    """The sweep scored by a model (M5): for every decay combination and validation period a ranker is fitted on
    the earlier periods, with both form features under the combination's decay, and judged by the expected points
    error; one row a combination with the mean over folds.

    ``matrix`` has the other features (``plans.matrix.feature_table``). Combinations that give one training matrix are
    fitted once, and those whose validation matrix is the same too share the error (``_classes``); ``same_as`` is the
    combination scored in the last fold. None is left out. The feature vectors are written once, by period, for every
    entry and distinct set of factors of its event; a fit reads those of its combination. A learner keeps its training
    rows cached for all its passes, so at most ``threads`` fits run side by side and only as many as the executors'
    storage memory holds. The driver gets one error a fit and validation matrix.
    """
    kw = dict(trees=80, rate=0.05, depth=4, min_rows=20)
    kw.update(ranker_kw or {})
    spark, folds = entries.sparkSession, sorted(params.validation_periods)
    others = [c for c in features if c not in FORMS]
    inputs = sweep_inputs(entries, params, spec, up_to=folds[-1])
    rows = materialize(inputs.join(matrix.select(spec.event, spec.entity, *others), [spec.event, spec.entity]), "sweep-rows")
    factors, names = event_factors(rows, params, spec, ranges)
    # an event's distinct sets of factors are numbered
    factors = materialize(factors.withColumns({
        "_set": F.dense_rank().over(Window.partitionBy(spec.event).orderBy(*names)),
        "_since": F.min(spec.period).over(Window.partitionBy(spec.event))}), "sweep-factors")
    classes = materialize(_classes(factors, names, folds, spec), "sweep-classes")
    entity_form = F.coalesce("_drv_ewma_raw", "_median") * F.col("_f0")
    team_form = fm.apply_factors(F.coalesce(F.col("_con_ewma_raw"), F.lit(0.0)), [F.col(n) for n in names[1:]])
    sets = factors.select(spec.event, "_set", *names).distinct()
    formed = rows.join(sets, spec.event).withColumns({
        FORMS[0]: entity_form, FORMS[1]: team_form, "_label": F.log1p(relevance_of(spec.outcome).cast("double"))})
    given = assemble(formed, features, keep=[spec.event, "_set", spec.period, spec.outcome, "_label"])
    path = scratch_path(spark, "sweep-vectors")
    given.write.partitionBy(spec.period).parquet(path)
    vectors = read_periods(spark, path, given.schema)
    # the extremes of an event's vectors, few rows, tell every fit which slots vary
    extremes = materialize(vectors.groupBy(spec.event, "_set", spec.period).agg(
        Summarizer.metrics("min", "max").summary(F.col("features")).alias("_s")).select(
        spec.event, "_set", spec.period, F.explode(F.array("_s.min", "_s.max")).alias("features")), "sweep-extremes")

    def split(data: DataFrame, combo: int, v: int) -> tuple[DataFrame, DataFrame]:
        mine = factors.filter((F.col("combo_id") == combo) & (F.col(spec.period) <= v)).select(spec.event, "_set")
        train, val = chrono_split(data, v, spec)
        return train.join(mine, [spec.event, "_set"]), val.join(mine, [spec.event, "_set"])

    sizes = {r[spec.period]: r["count"] for r in rows.groupBy(spec.period).count().collect()}
    room = Room(storage_bytes(spark))

    def fit(todo: tuple[int, int, list[int]]) -> list[tuple[int, int, float]]:
        v, combo, reps = todo
        with room.of(sum(n for p, n in sizes.items() if p < v) * cached_row_bytes(2 * len(features))):
            model = pointwise_trees(split(vectors, combo, v)[0].select("features", "_label"), params=params,
                                    extremes=split(extremes, combo, v)[0], **kw)
        errors = []
        for rep in reps:
            scored = model.transform(split(vectors, rep, v)[1]).select(spec.event, spec.outcome, F.col("prediction").alias("_score"))
            # written: ranks of large events read their rows several times
            ranked = rank_within(materialize(scored, "sweep-scores"), "_score", "_pred", spec, skew_safe=skew_safe)
            errors.append((v, rep, ranked.agg(F.avg(expected_points_error(F.col(spec.outcome), F.col("_pred")))).first()[0]))
        return errors

    shared = classes.groupBy("fold", "fitted").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    todo = [(int(r.fold), int(r.fitted), list(r.reps)) for r in shared.orderBy(F.desc("fold"), "fitted").collect()]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        found = [e for some in pool.map(inheritable_thread_target(fit), todo) for e in some]
    errors = spark.createDataFrame(found, "fold bigint, rep bigint, _err double")
    per = classes.join(errors, ["fold", "rep"]).groupBy("combo_id").agg(
        F.avg("_err").alias("mean_exp_pts_err"), F.count(F.lit(1)).alias("folds"), F.max_by("rep", "fold").alias("same_as"))
    return param_grid(spark, ranges).join(per, "combo_id")


def best_params(sweep: DataFrame) -> DataFrame:
    """Arg-min of the mean error; ties go to the lowest combo_id.

    Errors are compared at 9 decimals so that combinations with the same
    predictions tie exactly whatever the summation order was."""
    names = [c for c in sweep.columns if c not in ("combo_id", "mean_exp_pts_err", "folds", "same_as")]
    best = sweep.agg(F.min_by(F.struct("combo_id", *names, "mean_exp_pts_err"),
                              F.struct(F.round("mean_exp_pts_err", 9), "combo_id")).alias("b"))
    return best.select("b.*")
