"""

Every query reads the driver's tables (``lineitem``/``supplier`` through the
panel adapter, or other tables directly) over their whole extent and returns
key columns plus the computed columns, doubles rounded to 6 digits so the
Spark result and the DuckDB oracle hash alike.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paddock.operators import event as ev  # noqa: E402
from paddock.operators import form as fm  # noqa: E402
from paddock.operators import reliability as rl  # noqa: E402
from paddock.operators import venue as vn  # noqa: E402
from paddock.functions import scalars as sc  # noqa: E402
from paddock.plans import matrix as mx  # noqa: E402
from paddock.plans import metrics as mt  # noqa: E402
from paddock.plans import validate as vd  # noqa: E402
from paddock.session import ensure_checkpoint_dir, materialize  # noqa: E402
from paddock.sources import raw  # noqa: E402
from paddock.sources.adapter import derived_strings, star_facts  # noqa: E402
from paddock.spec import ADAPTER_SWEEP_GRID, FEATURES, adapter_params  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
# The adapter's events are calendar months (each ~1/84 of all line items):
# per-event orders use the skew-safe rank rather than a window per event.
SKEW_SAFE = True
P = adapter_params()


def _r(df: DataFrame, keep: list[str], doubles: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in doubles])


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    r, q, s = star_facts(spark, sf)
    return mx.entries_table(r, q, s, P)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    r, q, s = star_facts(spark, sf)
    return mx.feature_table(r, q, s, P)


def q_matrix(spark, sf):
    ensure_checkpoint_dir(spark)
    r, q, s = star_facts(spark, sf)
    m = mx.feature_matrix(r, q, s, P)
    return m.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.simpleString() == "double"
                      else F.col(f.name) for f in m.schema.fields])


def q_drop_non_starters(spark, sf):
    r, _, _ = star_facts(spark, sf)
    r = r.filter(F.col("season") >= P.first_period)
    return ev.drop_non_starters(r).select("raceId", "driverId", "status")


def q_attach_facts(spark, sf):
    r, q, s = star_facts(spark, sf)
    df = ev.attach_facts(ev.drop_non_starters(r.filter(F.col("season") >= P.first_period)), q, s)
    return _r(df, ["raceId", "driverId"], ["qualifying_pos", "driver_best_q_ms", "sprint_finish", "sprint_points"])


def q_start_features(spark, sf):
    return _r(_entries(spark, sf), ["raceId", "driverId"], ["qualifying_pos", "grid_penalty_delta"])


def q_event_extremes(spark, sf):
    ext = ev.event_extremes(_entries(spark, sf))
    return _r(ext.select("raceId", F.col("_pole").alias("pole_ms"), F.col("_slowest").alias("slowest_ms"),
                         ev._pct_delta(F.col("_slowest"), F.col("_pole")).alias("slowest_pace_pct")),
              ["raceId"], ["pole_ms", "slowest_ms", "slowest_pace_pct"])


def q_pace_delta(spark, sf):
    base = _entries(spark, sf)
    ext = ev.event_extremes(base)
    df = base.join(ext, "raceId", "left").select(
        "raceId", "driverId", ev._pct_delta(F.col("driver_best_q_ms"), F.col("_pole")).alias("pace_delta_pct"))
    return _r(df, ["raceId", "driverId"], ["pace_delta_pct"])


def q_peer_value(spark, sf):
    base = _entries(spark, sf)
    ext = ev.event_extremes(base)
    df = base.join(ext, "raceId", "left").withColumn(
        "pace_delta_pct", ev._pct_delta(F.col("driver_best_q_ms"), F.col("_pole")))
    df = ev.peer_first_values(df, ["driver_best_q_ms", "pace_delta_pct", "positionOrder"])
    return _r(df, ["raceId", "driverId"], ["driver_best_q_ms_tm", "pace_delta_pct_tm", "positionOrder_tm"])


def _pace(spark, sf):
    base = _entries(spark, sf)
    return ev.pace_features(base, P, source=base)


def q_pace_fill(spark, sf):
    return _r(_pace(spark, sf), ["raceId", "driverId"], ["pace_delta_pct"])


def q_teammate_delta(spark, sf):
    return _r(_pace(spark, sf), ["raceId", "driverId"], ["teammate_delta_pct"])


def q_h2h_win(spark, sf):
    return _r(_pace(spark, sf), ["raceId", "driverId"], ["h2h_win"])


def q_h2h_form(spark, sf):
    return _r(fm.h2h_form(_pace(spark, sf), P), ["raceId", "driverId"], ["teammate_h2h_form"])


def q_weekend_reward(spark, sf):
    return _r(fm.weekend_reward(_entries(spark, sf)), ["raceId", "driverId"], ["sprint_points", "total_weekend_pts"])


def q_driver_points_lag(spark, sf):
    df = fm.driver_points_lag(fm.weekend_reward(_entries(spark, sf)))
    return _r(df, ["raceId", "driverId"], ["driver_pts_lag"])


def _totals(spark, sf):
    return fm.team_event_totals(fm.weekend_reward(_entries(spark, sf)))


def q_team_totals(spark, sf):
    return _r(_totals(spark, sf), ["season", "round", "constructorId"], ["team_total"])


def q_team_points_lag(spark, sf):
    t = fm._lagged_running_sum(_totals(spark, sf), "team_total", ["season", "constructorId"], ["round"],
                               "team_pts_lag")
    return _r(t, ["season", "round", "constructorId"], ["team_pts_lag"])


def q_global_median(spark, sf):
    return _r(fm.global_median(_entries(spark, sf), "positionOrder", P).withColumnRenamed(
        "_median", "median_outcome"), [], ["median_outcome"])


def q_entity_form_raw(spark, sf):
    df = fm.ewma_prior(_entries(spark, sf), "positionOrder", ["driverId"], ["season", "round"],
                       P.ewma_alpha, "form_raw", SKEW_SAFE)
    return _r(df, ["raceId", "driverId"], ["form_raw"])


def q_team_form_raw(spark, sf):
    df = fm.ewma_prior(_totals(spark, sf), "team_total", ["constructorId"], ["season", "round"],
                       P.ewma_alpha, "form_raw", SKEW_SAFE)
    return _r(df, ["season", "round", "constructorId"], ["form_raw"])


def q_period_first_seq(spark, sf):
    return fm.period_first_seq(_entries(spark, sf)).withColumnRenamed("_first_seq", "first_round")


def q_decayed_form(spark, sf):
    base = _entries(spark, sf)
    totals = fm.team_event_totals(fm.weekend_reward(base))
    df = fm.decayed_form(base, totals, P, source=base)
    return _r(df, ["raceId", "driverId"], ["driver_form_ewma", "constructor_form_ewma"])


def q_venue_retention(spark, sf):
    return _r(vn.venue_retention(_entries(spark, sf), P), ["circuitId", "season"],
              ["track_retention_idx", "track_retention_confidence"])


def q_global_retention(spark, sf):
    g = vn.global_retention(vn.retention_inputs(_entries(spark, sf), P), P)
    return _r(g, [], ["global_retention"])


def q_venue_event_rate(spark, sf):
    return _r(rl.venue_event_rate(_entries(spark, sf), P), ["circuitId", "season"], ["circuit_dnf_rate_5yr"])


def q_fail_rates(spark, sf):
    base = _entries(spark, sf)
    df = rl.reliability_features(base, P, source=base)
    return _r(df, ["raceId", "driverId"], ["driver_dnf_rate_10", "constructor_dnf_rate_10",
                                          "driver_team_dnf_rate_10", "pu_dnf_rate_10"])


def q_labels(spark, sf):
    return _entries(spark, sf).select("raceId", "driverId", "regulatory_era", "is_classified", "pu_manufacturer")


def _test_matrix(spark, sf):
    """Feature matrix of the test period, with the start column and the reference's baselines. Columns that only lead
    to features are not written."""
    full = materialize(_features(spark, sf).filter(F.col("season") == P.test_period).select(
        *mx.MATRIX_COLUMNS, "grid"), "test-period")
    # adapter events are calendar months: use the skew-safe ranks
    return mt.baseline_predictions(full, skew_safe=SKEW_SAFE)


STRATEGIES = {"grid": "grid", "qualifying": "qualifying_pos", "championship": "championship_pred_pos"}
METRIC_COLS = ["exp_pts_err", "p1_acc", "top3_acc", "top10_acc", "spearman_rho", "mae"]


def q_compare_strategies(spark, sf):
    res = mt.compare_strategies(_test_matrix(spark, sf), STRATEGIES, skew_safe=SKEW_SAFE)
    return _r(res, ["strategy", "events"], METRIC_COLS)


def q_rank_baseline(spark, sf):
    df = _test_matrix(spark, sf)
    df = mt.rank_within(df, "driver_form_ewma", "form_pred_pos", ascending=True, skew_safe=SKEW_SAFE)
    return df.select("raceId", "driverId", "championship_pred_pos", "form_pred_pos")


def q_ndcg(spark, sf):
    res = mt.ndcg_at_k(_test_matrix(spark, sf), "driver_pts_lag", P.ndcg_cuts)
    return _r(res, [], [f"ndcg_{k}" for k in P.ndcg_cuts])


def q_split_profile(spark, sf):
    full = _features(spark, sf)
    train, test = mt.chrono_split(full, P.test_period)
    prof = mt.split_profile(train).withColumn("split", F.lit("train")).unionByName(
        mt.split_profile(test).withColumn("split", F.lit("test")))
    return _r(prof, ["split", "min_period", "max_period", "events", "rows"], ["dnf_rate"])


def q_classification_accuracy(spark, sf):
    df = _test_matrix(spark, sf).withColumn(
        "predicted_classified",
        ((F.lit(1.0) - F.col("driver_dnf_rate_10")) >= F.lit(P.classify_threshold)).cast("bigint"))
    return _r(mt.classification_accuracy(df, "predicted_classified"), [], ["accuracy"])


def _sweep(spark, sf):
    return vd.sweep_decay(_entries(spark, sf), P, ranges=ADAPTER_SWEEP_GRID, skew_safe=SKEW_SAFE)


def q_sweep_decay(spark, sf):
    res = _sweep(spark, sf)
    return _r(res, ["combo_id", "summer_break_round", "folds"],
              ["off_season_decay", "regulation_reset_decay", "summer_break_decay", "driver_reg_reset_decay",
               "mean_exp_pts_err"])


# without a summer break the round does not matter: 12 combinations, four matrices a fold at most
MODEL_SWEEP = {"off_season_decay": (0.5, 0.9), "regulation_reset_decay": (0.1, 0.4), "summer_break_decay": (1.0,),
               "driver_reg_reset_decay": (0.5,), "summer_break_round": (7, 8, 9)}


def q_sweep_models(spark, sf):
    """The sweep scored by a model: the grid, its folds, whose fit a combination shares, and whether errors are points."""
    base = _entries(spark, sf)
    res = vd.sweep_models(mx.features_of(base, P), base, P, ranges=MODEL_SWEEP, skew_safe=SKEW_SAFE,
                          ranker_kw=dict(trees=10, rate=0.2, depth=4))
    return res.select("combo_id", "off_season_decay", "regulation_reset_decay", "summer_break_round", "folds", "same_as",
                      F.col("mean_exp_pts_err").between(0.0, 25.0).alias("error_in_points"))


def q_best_params(spark, sf):
    res = vd.best_params(_sweep(spark, sf))
    return _r(res, ["combo_id", "summer_break_round"],
              ["off_season_decay", "regulation_reset_decay", "summer_break_decay", "driver_reg_reset_decay",
               "mean_exp_pts_err"])


def q_distinct_counts(spark, sf):
    base = _entries(spark, sf)
    return base.groupBy("circuitId").agg(
        F.countDistinct("season").alias("periods"), F.countDistinct("raceId").alias("events"),
        F.countDistinct("driverId").alias("entities"))


def _agg_strings(spark, sf):
    """Lap-time strings and numeric strings derived from the line items."""
    return derived_strings(spark, sf)


def q_lap_time_ms(spark, sf):
    df = _agg_strings(spark, sf)
    out = df.select("l_orderkey", "l_linenumber",
                    sc.lap_time_ms("lap").alias("q1_ms"), sc.lap_time_ms("lap_short").alias("q2_ms"),
                    sc.lap_time_ms("numtxt").alias("q3_ms"))
    out = out.withColumn("best_ms", sc.best_of("q1_ms", "q2_ms", "q3_ms"))
    return _r(out, ["l_orderkey", "l_linenumber"], ["q1_ms", "q2_ms", "q3_ms", "best_ms"])


def q_numeric_coercion(spark, sf):
    df = _agg_strings(spark, sf)
    return _r(df.select("l_orderkey", "l_linenumber", sc.normalize_null("numtxt").alias("clean_txt"),
                        sc.to_number(sc.normalize_null("numtxt")).alias("num"),
                        sc.to_int(sc.normalize_null("numtxt"), 0).alias("int_or_zero")),
              ["l_orderkey", "l_linenumber", "clean_txt", "int_or_zero"], ["num"])


def q_event_key(spark, sf):
    r, _, _ = star_facts(spark, sf)
    return r.select(sc.event_key(F.col("season").cast("string"), F.col("round").cast("string")).alias("key"),
                    "raceId").distinct()


def q_position_maps(spark, sf):
    r, _, _ = star_facts(spark, sf)
    return _r(r.select("raceId", "driverId", sc.relevance_of("positionOrder").alias("relevance"),
                       sc.points_of("grid").alias("grid_points")),
              ["raceId", "driverId", "relevance"], ["grid_points"])


def _landed(spark, sf, *kinds, **how):
    """Land the adapter's facts as nested JSON pages of some kinds in a fresh
    scratch folder under the shared checkpoint folder; returns the pages."""
    from paddock.session import scratch_path
    from paddock.sources.landing import land_facts
    r, q, s = star_facts(spark, sf)
    root = scratch_path(spark, "landing")
    land_facts(r, q, s, root, kinds=kinds, **how)
    return raw.read_raw(spark, raw.landing_paths(root, *kinds), lines=True)


def q_parse_results(spark, sf):
    df = raw.parse_results(_landed(spark, sf, "results"), P)
    return _r(df, ["raceId", "season", "round", "circuitId", "driverId", "constructorId", "status"],
              ["grid", "positionOrder", "points"])


def _soiled(spark, sf) -> tuple[str, dict[str, int]]:
    """Dirty results pages, quarantined: the table's folder and the counts that were observed while writing it."""
    from paddock.session import scratch_path
    from paddock.sources.landing import land_soiled
    root, path = scratch_path(spark, "soiled-landing"), scratch_path(spark, "quarantine")
    land_soiled(star_facts(spark, sf)[0], root)
    return path, raw.quarantine_results(raw.read_raw(spark, raw.landing_paths(root, "results"), lines=True), path, P)


def q_quarantine(spark, sf):
    """Rows of each kind, as observed and as stored, and the facts that are left of repeated ones."""
    path, counts = _soiled(spark, sf)
    kept = raw.read_quarantined(spark, path, "facts").agg(F.count(F.lit(1)).alias("n")).scalar()
    stored = spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("stored"))
    observed = spark.createDataFrame(list(counts.items()), "kind string, observed long")
    return observed.join(stored, "kind", "left").select(
        "kind", "observed", F.coalesce("stored", F.lit(0)).alias("stored"), F.when(F.col("kind") == "facts", kept).alias("kept"))


def q_soiled_facts(spark, sf):
    df = raw.read_quarantined(spark, _soiled(spark, sf)[0], "facts")
    return _r(df, ["raceId", "season", "round", "circuitId", "driverId", "constructorId", "status"],
              ["grid", "positionOrder", "points"])


def q_soiled_starters(spark, sf):
    df = ev.drop_non_starters(raw.read_quarantined(spark, _soiled(spark, sf)[0], "facts"))
    return _r(df, ["raceId", "driverId", "status"], ["positionOrder", "points"])


def q_parse_qualifying(spark, sf):
    df = raw.parse_qualifying(_landed(spark, sf, "qualifying"), P)
    return _r(df, ["raceId", "driverId"], ["qualifying_pos", "q1_ms", "q2_ms", "q3_ms", "driver_best_q_ms"])


def q_parse_sprints(spark, sf):
    df = raw.parse_sprints(_landed(spark, sf, "sprint"), P)
    return _r(df, ["raceId", "driverId"], ["sprint_finish", "sprint_points"])


def q_missing_pages(spark, sf):
    """Pages of 25; every third page from the second on is never landed."""
    pages = _landed(spark, sf, "results", "qualifying", "sprint", page_size=25, skip=F.col("_page") % 3 == 1)
    return raw.missing_pages(pages, 25)


def q_pending_requests(spark, sf):
    r, _, _ = star_facts(spark, sf)
    return raw.pending_requests(r, _landed(spark, sf, "results", "qualifying", "sprint"))


def q_active_entities(spark, sf):
    return raw.active_entities(_landed(spark, sf, "active_drivers"))


def q_active_teams(spark, sf):
    return raw.active_entities(_landed(spark, sf, "active_constructors"), "constructor")


def q_race_lists(spark, sf):
    """The event universe from race lists of every entity, read for the entities of the latest period."""
    pages = _landed(spark, sf, "driver_races", "active_drivers")
    listing = pages.filter(F.col("_file").startswith("active_drivers"))
    period = F.regexp_extract("_file", r"active_drivers_([0-9]+)_offset", 1).cast("bigint")
    latest = listing.select(F.max(period).alias("p")).scalar()
    active = raw.active_entities(listing.filter(period == latest))
    return raw.race_list_universe(pages.filter(F.col("_file").startswith("driver_")), active, P.first_period)


def q_event_universe(spark, sf):
    pages = _landed(spark, sf, "results", "active_drivers")
    listing = pages.filter(F.col("_file").startswith("active_drivers"))
    period = F.regexp_extract("_file", r"active_drivers_([0-9]+)_offset", 1).cast("bigint")
    latest = listing.select(F.max(period).alias("p")).scalar()
    active = raw.active_entities(listing.filter(period == latest))
    return raw.event_universe(pages.filter(F.col("_file").startswith("race_")), active, P.first_period)


def q_ingest_incremental(spark, sf):
    """Two landed batches, an ingest after each, and a last one that finds nothing new."""
    from paddock.session import scratch_path
    from paddock.sources.landing import land_facts
    from paddock.streaming.ingest import ingest_incremental, read_ingested
    r, q, s = star_facts(spark, sf)
    root, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "facts", "stream-ckpt"))
    for batch in (r.filter(F.col("season") < P.test_period - 2), r.filter(F.col("season") >= P.test_period - 2)):
        land_facts(batch, q, s, root, kinds=["results"])
        ingest_incremental(spark, raw.landing_paths(root, "results")[0], sink, ckpt, P, lines=True)
    ingest_incremental(spark, raw.landing_paths(root, "results")[0], sink, ckpt, P, lines=True)
    df = read_ingested(spark, sink)
    return _r(df, ["raceId", "season", "round", "circuitId", "driverId", "constructorId", "status"],
              ["grid", "positionOrder", "points"])


def q_ingest_merged(spark, sf):
    """Two landed batches, the later seasons' pages landed again, and a pass over all of it from a new checkpoint;
    each is merged into the table by event."""
    from paddock.session import scratch_path
    from paddock.sources.landing import land_facts
    from paddock.streaming.ingest import ingest_merged, read_merged
    r, q, s = star_facts(spark, sf)
    root, table, ckpt, again = (scratch_path(spark, n) for n in ("landing", "merged-facts", "stream-ckpt", "stream-ckpt"))
    late = r.filter(F.col("season") >= P.test_period - 2)
    for batch in (r.filter(F.col("season") < P.test_period - 2), late, late):
        land_facts(batch, q, s, root, kinds=["results"])
        ingest_merged(spark, raw.landing_paths(root, "results")[0], table, ckpt, P, lines=True)
    ingest_merged(spark, raw.landing_paths(root, "results")[0], table, again, P, lines=True)
    return _r(read_merged(spark, table), ["raceId", "season", "round", "circuitId", "driverId", "constructorId", "status"],
              ["grid", "positionOrder", "points"])


def q_event_rates(spark, sf):
    """Failure rates over whole earlier events: the leak-free mode."""
    base = _entries(spark, sf)
    p = P.with_(reliability_mode="events")
    team = rl.rolling_prior_rate(base, ["constructorId"], "is_dnf", "team_rate", p)
    supplier = rl.rolling_prior_rate(base, ["pu_manufacturer"], "is_dnf", "supplier_rate", p)
    return _r(team.join(supplier, ["raceId", "driverId"]), ["raceId", "driverId"], ["team_rate", "supplier_rate"])


def q_as_of(spark, sf):
    """The global median and retention mean as known before the test period."""
    base, p = _entries(spark, sf), P.with_(as_of_period=P.test_period)
    g = vn.global_retention(vn.retention_inputs(base, p), p).select("global_retention").scalar()
    return _r(fm.global_median(base, "positionOrder", p).withColumn("global_retention", g),
              [], ["_median", "global_retention"]).withColumnRenamed("_median", "median_outcome")


def q_group_sizes(spark, sf):
    return _entries(spark, sf).groupBy("raceId").agg(F.count(F.lit(1)).alias("entries"))


def q_extended_matrix(spark, sf):
    r, q, s = star_facts(spark, sf)
    ext = mx.extended_matrix(r, q, s, P)
    return _r(ext, ["raceId", "driverId", "is_sprint_weekend"],
              ["grid", "team_point_contribution_pct", "pace_x_overtaking", "grid_x_retention"])


def q_params_artifact(spark, sf):
    from paddock.session import scratch_path
    best = vd.best_params(_sweep(spark, sf)).first()
    chosen = P.with_(off_season_decay=best.off_season_decay, regulation_reset_decay=best.regulation_reset_decay,
                     summer_break_decay=best.summer_break_decay, driver_reg_reset_decay=best.driver_reg_reset_decay,
                     summer_seq=int(best.summer_break_round))
    path = scratch_path(spark, "params")
    raw.save_params(spark, chosen, path)
    return _r(spark.read.parquet(path), ["summer_break_round"],
              ["off_season_decay", "regulation_reset_decay", "summer_break_decay", "driver_reg_reset_decay"])


def _split(spark, sf):
    """Both splits of one written feature table: it is computed once."""
    return mt.chrono_split(materialize(_features(spark, sf), "features"), P.test_period)


# The model queries return what is exact (rows, ranks, baselines) and gates
# that are computed from the models' output; scores themselves depend on the learner.
SMALL = dict(trees=40, rate=0.1, depth=4)


def q_fit_ranker(spark, sf):
    """Per event: entries, whether ranks follow the scores, and whether the
    model's NDCG reaches that of a random order."""
    from paddock.operators.venue import spearman
    from paddock.plans import models as md
    train, test = _split(spark, sf)
    model = md.fit_ranker(train, params=P, **SMALL)
    out = materialize(md.score_ranker(model, test, skew_safe=SKEW_SAFE).select(
        "raceId", "driverId", "positionOrder", "score", "pred_pos",
        F.xxhash64("raceId", "driverId").alias("shuffled")), "ranker-scores")
    k = P.ndcg_cuts[-1]
    better = mt.ndcg_at_k(out, "score", P.ndcg_cuts).select(F.col(f"ndcg_{k}").alias("v")).scalar() \
        >= mt.ndcg_at_k(out, "shuffled", P.ndcg_cuts).select(F.col(f"ndcg_{k}").alias("v")).scalar()
    follow = spearman(out, ["raceId"], "score", "pred_pos", "rho")
    return out.groupBy("raceId").agg(
        F.count(F.lit(1)).alias("entries"), F.min("pred_pos").alias("first_pos"),
        (F.max("pred_pos") <= F.count(F.lit(1))).alias("within")).join(follow, "raceId").select(
        "raceId", "entries", "first_pos", (F.col("within") & (F.coalesce("rho", F.lit(-1.0)) < -1 + 1e-9))
        .alias("ranks_follow"), better.alias("beats_random"))


def q_listwise_ranker(spark, sf):
    """Per event: entries, whether the listwise ranker's ranks follow its scores, and whether its NDCG on later
    events is above that of a random order."""
    from paddock.operators.venue import spearman
    from paddock.plans import models as md
    train, test = _split(spark, sf)
    model = md.fit_ranker(train, params=P, method="listwise", trees=12, rate=0.5, depth=4)
    out = materialize(md.score_ranker(model, test, skew_safe=SKEW_SAFE).select(
        "raceId", "driverId", "positionOrder", "score", "pred_pos",
        F.xxhash64("raceId", "driverId").alias("shuffled")), "listwise-scores")
    k = P.ndcg_cuts[-1]
    better = mt.ndcg_at_k(out, "score", P.ndcg_cuts).select(F.col(f"ndcg_{k}").alias("v")).scalar() \
        > mt.ndcg_at_k(out, "shuffled", P.ndcg_cuts).select(F.col(f"ndcg_{k}").alias("v")).scalar()
    follow = spearman(out, ["raceId"], "score", "pred_pos", "rho")
    return out.groupBy("raceId").agg(F.count(F.lit(1)).alias("entries"), F.min("pred_pos").alias("first_pos")) \
        .join(follow, "raceId").select("raceId", "entries", "first_pos", (F.col("rho") < -1 + 1e-9).alias("ranks_follow"),
                                       better.alias("beats_random"))


RATE_COLUMNS = ("driverId", "constructorId", "circuitId", "pu_manufacturer", "regulatory_era")


def q_category_rates(spark, sf):
    from paddock.plans.encode import category_rates
    out = category_rates(_entries(spark, sf), RATE_COLUMNS, F.col("is_classified"), until=P.test_period)
    return _r(out, ["raceId", "driverId"], [f"{c}__rate" for c in RATE_COLUMNS])


def q_partitioned_matrix(spark, sf):
    """A store by season: all seasons written, two of them replaced, read back split by period."""
    from paddock.session import scratch_path
    from paddock.sources.store import read_periods, write_periods
    rows = _entries(spark, sf).select("raceId", "driverId", "season", "positionOrder", F.lit(1).alias("version"))
    path = scratch_path(spark, "matrix-store")
    write_periods(rows, path)
    again = rows.filter(F.col("season").isin(P.test_period - 1, P.test_period) & (F.col("positionOrder") <= 10))
    write_periods(again.withColumn("version", F.lit(2)), path)
    train, test = mt.chrono_split(read_periods(spark, path, rows.schema), P.test_period)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "season").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("positionOrder").alias("positions"),
        F.min("version").cast("bigint").alias("oldest"), F.max("version").cast("bigint").alias("newest"))


def q_merge_stages(spark, sf):
    """P28 on fixed scores: flags and scores from the entries, positions merged."""
    from paddock.plans import models as md
    rows = _entries(spark, sf).filter(F.col("season") == P.test_period).select(
        "raceId", "driverId", F.col("is_classified").alias("predicted_classified"),
        (-F.col("grid") % 17).alias("rank_score"),
        F.when(F.col("grid") % 5 != 0, (F.col("positionOrder") % 7) / 10).alias("survival_prob"))
    return md.merge_stages(rows, skew_safe=SKEW_SAFE).select(
        "raceId", "driverId", "two_stage_pred_pos", "single_stage_pred_pos")


def q_classifier(spark, sf):
    """Per event: entries, whether flags follow the probabilities, and whether
    the log loss is below that of a coin."""
    from paddock.plans import models as md
    train, test = _split(spark, sf)
    out = materialize(md.classify(md.fit_classifier(train, params=P, **SMALL), test, params=P).select(
        "raceId", "survival_prob", "predicted_classified", "is_classified"), "survival")
    p = F.greatest(F.least(F.col("survival_prob"), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = out.agg(F.avg(-F.when(F.col("is_classified") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("v")).scalar()
    flag = (F.col("survival_prob") >= P.classify_threshold).cast("bigint")
    return out.groupBy("raceId").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("is_classified").cast("bigint").alias("classified"),
        F.bool_and(F.col("survival_prob").between(0, 1) & (flag == F.col("predicted_classified")))
        .alias("flags_follow")).withColumn("beats_coin", loss < F.log(F.lit(2.0)))


def q_two_stage(spark, sf):
    """All five strategies: exact metrics of the baselines; for the models the
    events and whether their metrics are in range (their values depend on the
    learner and are null here)."""
    from paddock.plans import models as md
    from paddock.spec import CATEGORICAL
    train, test = _split(spark, sf)
    test = mt.baseline_predictions(test, skew_safe=SKEW_SAFE)
    ranked = materialize(md.two_stage_rank(
        train, test, params=P, categorical=CATEGORICAL, ranker_kw=SMALL, classifier_kw=SMALL,
        skew_safe=SKEW_SAFE), "two-stage")
    models = {"single_stage": "single_stage_pred_pos", "two_stage": "two_stage_pred_pos"}
    res = mt.compare_strategies(ranked, {**STRATEGIES, **models}, skew_safe=SKEW_SAFE)
    in_range = F.col("spearman_rho").between(-1, 1) & (F.col("mae") >= 0) & (F.col("exp_pts_err") >= 0)
    for c in ("p1_acc", "top3_acc", "top10_acc"):
        in_range = in_range & F.col(c).between(0, 100)
    exact = F.col("strategy").isin(list(STRATEGIES))
    return res.select("strategy", "events", in_range.alias("in_range"), *[
        F.when(exact, F.round(c, 6)).alias(c) for c in METRIC_COLS])


def q_chrono_cv(spark, sf):
    cv = vd.chrono_cv(_features(spark, sf), P, ranker_kw=SMALL, skew_safe=SKEW_SAFE)
    return cv.select("fold", "events", "train_rows", "val_rows", "scored_rows", F.round("pace_rho", 6).alias("pace_rho"),
                     (F.col("model_rho").between(-1, 1) & F.col("p1_acc").between(0, 100)).alias("in_range"))


def q_leakage_alarm(spark, sf):
    """The alarm on the clean matrix and on one with a planted copy of the outcome."""
    from paddock.plans import models as md
    r, q, s = star_facts(spark, sf)
    ensure_checkpoint_dir(spark)
    clean = materialize(mx.feature_matrix(r, q, s, P), "alarm-matrix")
    planted = clean.withColumn("planted_outcome", F.col("positionOrder").cast("double"))

    def verdict(df, name):
        top = md.leakage_alarm(df, P).orderBy(F.desc("importance"), "feature").limit(1)
        return top.select(F.lit(name).alias("matrix"), "alarm",
                          F.when(F.col("alarm"), F.col("feature")).alias("named"))

    return verdict(clean, "clean").unionByName(verdict(planted, "planted")).withColumn(
        "rows", clean.agg(F.count(F.lit(1)).alias("n")).scalar())


def q_importances(spark, sf):
    """The ten largest importances by rank, checked: known features, descending,
    all importances adding up to one."""
    from pyspark.sql import Window

    from paddock.plans import models as md
    train, _ = _split(spark, sf)
    imp = md.importances(md.fit_ranker(train, params=P, **SMALL), md.feature_names(), spark)
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature of the spec
    top = imp.select("*", F.row_number().over(order).cast("bigint").alias("rank"),
                     F.lag("importance").over(order).alias("above"))
    total = imp.agg(F.sum("importance").alias("v")).scalar()
    return top.filter("rank <= 10").select(
        "rank", F.col("feature").isin(list(FEATURES)).alias("known"),
        (F.coalesce("above", F.lit(1.0)) >= F.col("importance")).alias("descending"),
        (F.abs(total - 1) < 1e-6).alias("complete"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p23_feature_matrix": q_matrix,
    "p10_drop_non_starters": q_drop_non_starters,
    "j1_j2_attach_facts": q_attach_facts,
    "p11_start_features": q_start_features,
    "w1_w2_event_extremes": q_event_extremes,
    "p12_pace_delta": q_pace_delta,
    "j3_peer_value": q_peer_value,
    "p13_pace_fill": q_pace_fill,
    "p14_teammate_delta": q_teammate_delta,
    "p15_h2h_win": q_h2h_win,
    "w3_h2h_form": q_h2h_form,
    "p16_weekend_reward": q_weekend_reward,
    "w4_driver_points_lag": q_driver_points_lag,
    "a1_team_event_totals": q_team_totals,
    "w5_team_points_lag": q_team_points_lag,
    "a4_global_median": q_global_median,
    "w6_entity_form_raw": q_entity_form_raw,
    "w7_team_form_raw": q_team_form_raw,
    "w12_period_first_seq": q_period_first_seq,
    "w16_decayed_form": q_decayed_form,
    "a6_venue_retention": q_venue_retention,
    "a7_global_retention": q_global_retention,
    "a8_venue_event_rate": q_venue_event_rate,
    "w8_w11_fail_rates": q_fail_rates,
    "p17_p19_labels": q_labels,
    "m8_compare_strategies": q_compare_strategies,
    "w14_w15_rank": q_rank_baseline,
    "a13_ndcg": q_ndcg,
    "a15_split_profile": q_split_profile,
    "a16_classification_accuracy": q_classification_accuracy,
    "m5_sweep_decay": q_sweep_decay,
    "m5_sweep_models": q_sweep_models,
    "a17_best_params": q_best_params,
    "a18_distinct_counts": q_distinct_counts,
    "p8_p9_lap_time_ms": q_lap_time_ms,
    "p6_p7_numeric_coercion": q_numeric_coercion,
    "p4_event_key": q_event_key,
    "p20_p22_position_maps": q_position_maps,
    "p1_parse_results": q_parse_results,
    "p1_p6_soiled_facts": q_soiled_facts,
    "p10_soiled_starters": q_soiled_starters,
    "u3_quarantine": q_quarantine,
    "p2_parse_qualifying": q_parse_qualifying,
    "p3_parse_sprints": q_parse_sprints,
    "s2_missing_pages": q_missing_pages,
    "s3_pending_requests": q_pending_requests,
    "s4_active_entities": q_active_entities,
    "s4_active_constructors": q_active_teams,
    "s5_event_universe": q_event_universe,
    "st1_ingest_incremental": q_ingest_incremental,
    "s5_race_lists": q_race_lists,
    "st1_ingest_merged": q_ingest_merged,
    "w9_w11_event_rates": q_event_rates,
    "a4_a7_as_of_period": q_as_of,
    "a3_group_sizes": q_group_sizes,
    "p29_p30_extended_matrix": q_extended_matrix,
    "s8_params_artifact": q_params_artifact,
    "m1_fit_ranker": q_fit_ranker,
    "m1_listwise_ranker": q_listwise_ranker,
    "p25_category_rates": q_category_rates,
    "s6_partitioned_matrix": q_partitioned_matrix,
    "p28_merge_stages": q_merge_stages,
    "m2_classifier": q_classifier,
    "m3_two_stage": q_two_stage,
    "m4_chrono_cv": q_chrono_cv,
    "m6_leakage_alarm": q_leakage_alarm,
    "m7_t2_importances": q_importances,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the full feature matrix over the sf0.001 tables."""
    return q_matrix(spark, SMOKE_DIR)


def _optional(name: str):
    """The module, or None where the text subpackage is not installed."""
    parent = name.rpartition(".")[0]
    if parent and importlib.util.find_spec(parent) is None or importlib.util.find_spec(name) is None:
        return None
    return importlib.import_module(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(_QUERIES)
    if (text := _optional("paddock.llm.queries")) is not None:
        found |= text.QUERIES
        if (pipeline := _optional("corpus_pipeline")) is not None:
            found["pipeline"] = pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    from oracle_sql import oracle_queries
    found = oracle_queries()
    if (text := _optional("paddock.llm.queries")) is not None:
        found |= text.ORACLE_SQL
        if (pipeline := _optional("corpus_pipeline")) is not None and pipeline.ORACLE_SQL:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found
