"""Plans: contract, entry point, metrics on hand-made predictions, plan shape."""

import math

import pytest
from pyspark.sql import functions as F

from paddock.plans import metrics as mt
from paddock.plans import matrix as mx
from paddock.plans import validate as vd


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.columns == list(mx.MATRIX_COLUMNS)
    assert df.count() > 0


def test_contract_rejects_drift(spark):
    df = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(ValueError):
        mx.check_contract(df)
    with pytest.raises(ValueError):
        mx.require_columns(df, ["points"])


def test_metric_bundle(spark):
    rows = [("r1", "a", 1.0, 1.0), ("r1", "b", 2.0, 3.0), ("r1", "c", 3.0, 2.0),
            ("r2", "a", 1.0, 2.0), ("r2", "b", 2.0, 1.0), ("r2", "c", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "raceId string, driverId string, positionOrder double, pred double")
    m = mt.compare_strategies(df, {"s": "pred"}).first()
    assert m.events == 2
    assert m.p1_acc == 50.0
    assert m.top3_acc == 100.0
    # points: r1 (25-25)+(18-15)+(15-18) -> 0,3,3 ; r2 7,7,0 -> mean 20/6
    assert math.isclose(m.exp_pts_err, 20 / 6)
    assert math.isclose(m.spearman_rho, (0.5 + 0.5) / 2)
    assert math.isclose(m.mae, 2 / 3)


def test_rank_ties_share_lowest(spark):
    df = spark.createDataFrame([("r", "a", 5.0), ("r", "b", 5.0), ("r", "c", 1.0)],
                               "raceId string, driverId string, s double")
    got = {r.driverId: r.p for r in mt.rank_within(df, "s", "p").collect()}
    assert got == {"a": 1, "b": 1, "c": 3}


def test_ndcg_perfect_order(spark):
    rows = [("r", "a", 1.0, 3.0), ("r", "b", 2.0, 2.0), ("r", "c", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "raceId string, driverId string, positionOrder double, s double")
    got = mt.ndcg_at_k(df, "s", (1, 3)).first()
    assert got.ndcg_1 == 1.0 and got.ndcg_3 == 1.0


def test_param_grid_order(spark):
    g = vd.param_grid(spark).orderBy("combo_id").collect()
    assert len(g) == 576
    assert (g[0].off_season_decay, g[0].summer_break_round) == (0.3, 13)
    assert (g[1].summer_break_round, g[-1].off_season_decay) == (14, 0.9)


def test_matrix_plan_has_no_cartesian_or_python(spark):
    from paddock.sources.adapter import star_facts
    from paddock.spec import adapter_params
    r, q, s = star_facts(spark, "/root/testdata/sf0.001")
    m = mx.feature_matrix(r, q, s, adapter_params())
    plan = m._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_two_stage_small(spark):
    """Two-stage ranking on a tiny synthetic panel with signal: runs, ranks
    every test entry, and predicted finishers come before predicted failures."""
    from paddock.plans import models as md
    from paddock.spec import CATEGORICAL, FEATURES
    rows = []
    for rnd in range(1, 13):
        for d in range(6):
            pos = float(d + 1)
            row = {f: float(d) for f in FEATURES}
            row.update(raceId=f"r{rnd}", season=2020 + rnd // 7, round=rnd, circuitId="c", driverId=f"d{d}",
                       constructorId=f"t{d // 2}", regulatory_era="e", positionOrder=pos,
                       is_classified=0 if d == 5 else 1)
            rows.append(row)
    df = spark.createDataFrame(rows)
    train, test = mt.chrono_split(df, 2021)
    out = md.two_stage_rank(train, test, ranker_kw=dict(trees=5), classifier_kw=dict(trees=5),
                            categorical=CATEGORICAL)
    got = out.select("raceId", "driverId", "predicted_classified", "two_stage_pred_pos").collect()
    assert len(got) == test.count()
    for r in got:
        if r.predicted_classified == 0:
            mates = [x for x in got if x.raceId == r.raceId and x.predicted_classified == 1]
            assert all(m.two_stage_pred_pos < r.two_stage_pred_pos for m in mates)


def _toy_matrix(spark, n=400):
    import random
    rng = random.Random(3)
    rows = [(f"2000_{i // 10}", f"d{i}", 2000 + i // 200, float(i % 10 + 1), rng.random(), f"c{i % 10}",
             int(i % 10 < 8)) for i in range(n)]
    return spark.createDataFrame(rows, "raceId string, driverId string, season long, positionOrder double, "
                                       "x double, circuitId string, is_classified long")


def test_category_columns_stay_categories(spark):
    from paddock.plans import models as md
    df = _toy_matrix(spark)
    with pytest.raises(ValueError, match="driverId"):  # too wide to index; never left out in silence
        md.index_categoricals(df, [df], ["circuitId", "driverId"], max_categories=20)
    train, (test,), idx = md.index_categoricals(df, [df], ["circuitId"], max_categories=20)
    assert idx == ["circuitId__idx"]
    model = md.fit_ranker(train, ["x"], trees=3, min_rows=1, categorical=idx)
    data = md.assemble(train, ["x"], categorical=idx)
    attrs = data.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attrs["nominal"]] == idx
    # the outcome is a function of the category alone: a tree on categories finds it with one split set
    assert "in {" in model.toDebugString
    imp = {r.feature: r.importance for r in md.importances(model, md.feature_names(["x"], idx), spark).collect()}
    assert set(imp) == {"x", "circuitId__idx"} and abs(sum(imp.values()) - 1) < 1e-9 and imp["circuitId__idx"] > 0.9


def test_leakage_alarm_names_a_copy_of_the_outcome(spark):
    from paddock.plans import models as md
    df = _toy_matrix(spark)
    clean = md.leakage_alarm(df.select("raceId", "driverId", "positionOrder", "x", "season"))
    assert not clean.filter("alarm").count()
    bad = md.leakage_alarm(df.select("positionOrder", "x", "season", (F.col("positionOrder") * 2).alias("copy")))
    assert bad.filter("alarm").count() == 3 and bad.first().feature == "copy"


def test_alarm_forest_counts_few_nodes_a_pass_and_grows_the_same_trees(spark, monkeypatch):
    from paddock.plans import models as md
    df = _toy_matrix(spark).select("positionOrder", "x", "season").coalesce(1)  # bags are drawn by partition
    made = []

    class Spy(md.RandomForestRegressor):
        def fit(self, data):
            made.append(self.getMaxMemoryInMB())
            return super().fit(data)

    monkeypatch.setattr(md, "RandomForestRegressor", Spy)
    few = md.leakage_alarm(df).collect()
    monkeypatch.setattr(md, "ALARM_MEMORY_MB", 256)
    assert md.leakage_alarm(df).collect() == few
    assert made == [2, 256]


def _fact_rows(spark):
    """Two events of two entities; one entry comes twice, one has no entity."""
    entries = [("2020_1", 1, "a", 1.0), ("2020_1", 1, "b", 2.0), ("2020_2", 2, "a", 2.0), ("2020_2", 2, "a", 1.0),
               ("2020_2", 2, None, 3.0)]
    results = spark.createDataFrame(
        [(e, 2020, n, "c", d, "t", pos, pos, 25.0 - pos, "Finished") for e, n, d, pos in entries],
        "raceId string, season long, round long, circuitId string, driverId string, constructorId string, grid double, "
        "positionOrder double, points double, status string")
    qualifying = spark.createDataFrame(
        [("2020_1", "a", 1.0, 100.0, None, 100.0, 100.0)],
        "raceId string, driverId string, qualifying_pos double, q1_ms double, q2_ms double, q3_ms double, "
        "driver_best_q_ms double")
    sprints = spark.createDataFrame([("2020_1", "a", 1.0, 8.0)],
                                    "raceId string, driverId string, sprint_finish double, sprint_points double")
    return results, qualifying, sprints


def test_extended_matrix_computes_its_features_once(spark):
    facts = _fact_rows(spark)
    once = mx.extended_matrix(*facts)
    assert "Window" not in once._jdf.queryExecution().optimizedPlan().toString()
    # the order of a repeated entry's copies is free, so only what does not depend on it is compared
    got = {(r.raceId, r.driverId, r.is_sprint_weekend) for r in once.collect() if r.driverId}
    assert got == {("2020_1", "a", 1), ("2020_1", "b", 1), ("2020_2", "a", 0)}


def test_test_period_table_holds_the_matrix_columns_only(spark):
    import __spark_entry__ as se
    got = se._test_matrix(spark, "/root/testdata/sf0.001").columns
    assert got == [*mx.MATRIX_COLUMNS, "grid", "championship_pred_pos"]


def test_each_sweep_parameter_changes_some_error(spark):
    from paddock.sources.adapter import star_facts
    from paddock.spec import ADAPTER_SWEEP_GRID, adapter_params
    p = adapter_params()
    entries = mx.entries_table(*star_facts(spark, "/root/testdata/sf0.001"), p)
    rows = vd.sweep_decay(entries, p, ranges=ADAPTER_SWEEP_GRID, skew_safe=True).collect()
    assert len(rows) == 576
    for name in ADAPTER_SWEEP_GRID:
        rest = [n for n in ADAPTER_SWEEP_GRID if n != name]
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[n] for n in rest), set()).add(round(r.mean_exp_pts_err, 9))
        assert any(len(g) > 1 for g in groups.values()), name
    window = vd.sweep_decay(entries, p, ranges=ADAPTER_SWEEP_GRID).collect()
    assert {(r.combo_id, round(r.mean_exp_pts_err, 9)) for r in rows} == {
        (r.combo_id, round(r.mean_exp_pts_err, 9)) for r in window}


def _panel(spark, events, entries, seed=4):
    """Order within an event follows x plus noise; every event shifts x by its own amount."""
    import random
    rng = random.Random(seed)
    rows = []
    for e in range(events):
        shift = rng.uniform(-50, 50)
        skill = [rng.uniform(0, 10) for _ in range(entries)]
        order = sorted(range(entries), key=lambda i: skill[i] + rng.uniform(-0.5, 0.5))
        for pos, i in enumerate(order):
            rows.append((f"{2000 + e // 20}_{e % 20}", 2000 + e // 20, e % 20, f"d{i}", float(pos + 1), skill[i] + shift / 25,
                         rng.random()))
    return spark.createDataFrame(rows, "raceId string, season long, round long, driverId string, positionOrder double, "
                                       "x double, y double")


def test_listwise_ranker_orders_within_events(spark):
    from paddock.plans import models as md
    df = _panel(spark, 80, 12)
    train, test = mt.chrono_split(df, 2003)
    kw = dict(trees=8, rate=0.5, depth=3, min_rows=5)
    ndcg = {}
    for method in ("pointwise", "listwise"):
        model = md.fit_ranker(train, ["x", "y"], method=method, **kw)
        scored = md.score_ranker(model, test, ["x", "y"])
        ndcg[method] = mt.ndcg_at_k(scored, "score", (10,)).first()[0]
        imp = {r.feature: r.importance for r in md.importances(model, md.feature_names(["x", "y"]), spark).collect()}
        assert abs(sum(imp.values()) - 1) < 1e-9 and imp["x"] > imp["y"]
    assert ndcg["listwise"] >= ndcg["pointwise"] and ndcg["listwise"] > 0.9
    with pytest.raises(ValueError, match="unknown"):
        md.fit_ranker(train, ["x"], method="pairwise")


def test_category_rates_see_earlier_events_only_at_any_width(spark):
    import random

    from paddock.plans.encode import category_rates
    rng = random.Random(2)
    rows = []
    for i in range(20_000):
        event = rng.randrange(30)
        cat = None if rng.random() < .05 else "hot" if rng.random() < .4 else f"c{rng.randrange(10_000)}"
        rows.append((i, f"{event // 10}_{event % 10}", event // 10, event % 10, cat, rng.choice([0.0, 1.0, None])))
    df = spark.createDataFrame(rows, "i long, raceId string, season long, round long, cat string, v double")
    for until in (None, 2):
        got = {r.i: r.cat__rate for r in category_rates(df, ["cat"], F.col("v"), until=until).collect()}
        sums, all_sums = {}, [0, 0.0]
        by_event = {}
        for r in rows:
            by_event.setdefault((r[2], r[3]), []).append(r)
        for key in sorted(by_event):
            prior = all_sums[1] / all_sums[0] if all_sums[0] else 0.5
            for r in by_event[key]:
                n, s = sums.get(r[4], (0, 0.0))
                assert abs(got[r[0]] - (s + 20 * prior) / (n + 20)) < 1e-9
            for r in by_event[key]:
                if r[5] is not None and (until is None or r[2] < until):
                    n, s = sums.get(r[4], (0, 0.0))
                    sums[r[4]] = n + 1, s + r[5]
                    all_sums = [all_sums[0] + 1, all_sums[1] + r[5]]


def test_period_store_overwrites_named_periods_and_prunes(spark, tmp_path):
    from paddock.sources.store import read_periods, write_periods
    df = spark.range(600).selectExpr("id", "id % 6 + 2000 AS season", "id * 2 AS v")
    path = str(tmp_path / "store")
    write_periods(df, path)
    write_periods(df.filter("season IN (2001, 2004) AND id < 300").withColumn("v", F.lit(-1).cast("bigint")), path)
    write_periods(df.limit(0), path)  # nothing to replace
    stored = read_periods(spark, path, df.schema)
    assert stored.schema.simpleString() == df.schema.simpleString()
    got = {r.season: (r.n, r.v) for r in stored.groupBy("season").agg(F.count("id").alias("n"), F.max("v").alias("v"))
           .collect()}
    assert got == {s: (50, -1) if s in (2001, 2004) else (100, (594 + s - 2000) * 2) for s in range(2000, 2006)}
    train, test = mt.chrono_split(stored, 2004)
    for part, rows, files in ((train, 350, "season#"), (test, 50, "season#")):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(season" in plan and files in plan and part.count() == rows


def test_two_stage_takes_wide_categories(spark):
    from paddock.plans import models as md
    df = _panel(spark, 60, 12).withColumn("is_classified", (F.col("positionOrder") < 11).cast("long")).withColumn(
        "wide", F.concat("driverId", F.lit("_"), (F.xxhash64("raceId") % 400).cast("string")))
    train, test = mt.chrono_split(df, 2002)
    _, coded, names = md.encode_split(train, test, ["wide", "driverId"])
    assert names == ["wide__rate", "wide__place", "driverId__rate", "driverId__place"]
    assert coded.columns == [*test.columns, *names] and coded.count() == test.count()
    one = coded.groupBy("driverId").agg(F.countDistinct("driverId__rate").alias("n"))
    assert one.filter("n <> 1").count() == 0  # the test split's own outcomes change nothing


def test_model_sweep_equals_fitting_each_combination(spark, monkeypatch):
    """12 combinations over two folds: six fits instead of 24, and the errors of 24 fits on separately built forms."""
    import itertools

    from paddock.operators import form as fm
    from paddock.plans import models as md
    from paddock.plans.metrics import chrono_split, expected_points_error, rank_within
    from paddock.sources.adapter import star_facts
    from paddock.spec import adapter_params
    p = adapter_params().with_(validation_periods=(1997, 1999))
    entries = mx.entries_table(*star_facts(spark, "/root/testdata/sf0.001"), p)
    ranges = {"off_season_decay": (0.5, 0.9), "regulation_reset_decay": (0.1, 0.4), "summer_break_decay": (1.0,),
              "driver_reg_reset_decay": (0.5,), "summer_break_round": (7, 8, 9)}
    features, kw = ["grid", "driver_form_ewma", "constructor_form_ewma"], dict(trees=2, rate=0.5, depth=3, min_rows=5)
    fits, trees = [], vd.pointwise_trees
    monkeypatch.setattr(vd, "pointwise_trees", lambda *a, **k: fits.append(1) or trees(*a, **k))
    got = {r.combo_id: r for r in vd.sweep_models(entries, entries, p, features, ranges=ranges, ranker_kw=kw).collect()}
    assert len(got) == 12 and len(fits) == 6 and all(r.folds == 2 for r in got.values())
    assert {i: r.same_as for i, r in got.items()} == {i: i - i % 3 for i in range(12)}
    totals = fm.team_event_totals(fm.weekend_reward(entries))
    for i, (off, reset, summer, own, rnd) in enumerate(itertools.product(*ranges.values())):
        mine = p.with_(off_season_decay=off, regulation_reset_decay=reset, summer_break_decay=summer,
                       driver_reg_reset_decay=own, summer_seq=rnd)
        formed = fm.decayed_form(entries, totals, mine)
        errors = []
        for v in mine.validation_periods:
            train, val = chrono_split(formed, v)
            out = md.score_ranker(md.fit_ranker(train, features, params=mine, **kw), val, features)
            ranked = rank_within(out, "score", "_pred")
            errors.append(ranked.agg(F.avg(expected_points_error(F.col("positionOrder"), F.col("_pred")))).first()[0])
        assert got[i].mean_exp_pts_err == pytest.approx(sum(errors) / 2, abs=1e-9), i


def test_model_sweep_writes_vectors_once_and_fits_equal_training_sets_once(spark, monkeypatch):
    """A reset in a fold's own period leaves its training set as it is: six fits for eight scored matrices, over vectors
    assembled once, one fit at a time when the storage memory holds no two; errors as of fitting each combination."""
    import itertools
    import random
    import threading

    from paddock.operators import form as fm
    from paddock.plans import models as md
    from paddock.plans.metrics import chrono_split, expected_points_error, rank_within
    from paddock.spec import Params
    rng = random.Random(7)
    rows = []
    for season, rnd in itertools.product((2000, 2001, 2002), (1, 2, 3)):
        order = rng.sample(range(24), 24)
        for pos, i in enumerate(order):
            rows.append((f"{season}_{rnd}", season, rnd, f"d{i:02}", f"t{i % 6}", rng.choice([None, float(pos + rng.randrange(4))]),
                         rng.choice([float(pos + 1)] * 15 + [None]), max(0.0, 25.0 - 3 * pos), rng.choice([None, 2.0])))
    entries = spark.createDataFrame(rows, "raceId string, season long, round long, driverId string, constructorId string, "
                                          "grid double, positionOrder double, points double, sprint_points double")
    p = Params().with_(validation_periods=(2001, 2002), reset_periods=(2001,), first_period=2000)
    ranges = {"off_season_decay": (0.5, 0.9), "regulation_reset_decay": (0.1, 0.4), "summer_break_decay": (1.0,),
              "driver_reg_reset_decay": (0.5,), "summer_break_round": (2, 3)}
    features, kw = ["grid", "driver_form_ewma", "constructor_form_ewma"], dict(trees=2, rate=0.5, depth=3, min_rows=2)
    trees, made, running, most, lock = vd.pointwise_trees, vd.assemble, [0], [], threading.Lock()
    assembled = []

    def fit(*a, **k):
        with lock:
            running[0] += 1
            most.append(running[0])
        try:
            return trees(*a, **k)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(vd, "pointwise_trees", fit)
    monkeypatch.setattr(vd, "assemble", lambda *a, **k: assembled.append(1) or made(*a, **k))
    monkeypatch.setattr(vd, "storage_bytes", lambda spark: 1, raising=False)
    got = {r.combo_id: r for r in vd.sweep_models(entries, entries, p, features, ranges=ranges, ranker_kw=kw).collect()}
    assert len(got) == 8 and len(most) == 6 and len(assembled) == 1 and max(most) == 1
    assert {i: r.same_as for i, r in got.items()} == {i: i - i % 2 for i in range(8)}
    totals = fm.team_event_totals(fm.weekend_reward(entries))
    for i, (off, reset, summer, own, rnd) in enumerate(itertools.product(*ranges.values())):
        mine = p.with_(off_season_decay=off, regulation_reset_decay=reset, summer_break_decay=summer,
                       driver_reg_reset_decay=own, summer_seq=rnd)
        if i % 2:
            assert got[i].mean_exp_pts_err == got[i - 1].mean_exp_pts_err
            continue
        formed = fm.decayed_form(entries, totals, mine)
        errors = []
        for v in mine.validation_periods:
            train, val = chrono_split(formed, v)
            out = md.score_ranker(md.fit_ranker(train, features, params=mine, **kw), val, features)
            ranked = rank_within(out, "score", "_pred")
            errors.append(ranked.agg(F.avg(expected_points_error(F.col("positionOrder"), F.col("_pred")))).first()[0])
        assert got[i].mean_exp_pts_err == pytest.approx(sum(errors) / 2, abs=1e-9), i
    assert len({round(r.mean_exp_pts_err, 9) for r in got.values()}) > 1


def test_room_admits_what_fits_side_by_side(spark):
    import threading

    from paddock.session import storage_bytes
    assert storage_bytes(spark) > 1 << 20
    room, inside, seen, lock = vd.Room(10), [], [], threading.Lock()

    def task(size):
        with room.of(size):
            with lock:
                inside.append(size)
                seen.append(tuple(inside))
            threading.Event().wait(0.05)
            with lock:
                inside.remove(size)

    threads = [threading.Thread(target=task, args=(s,)) for s in (6, 4, 20, 5, 5, 3, 30)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 7 and all(sum(s) <= 10 or len(s) == 1 for s in seen) and any(len(s) > 1 for s in seen)
    assert room.held == 0
