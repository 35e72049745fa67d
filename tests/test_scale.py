"""Steps whose cost grew faster than the panel: what their plans do, and the same results as plain forms."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as se
from paddock.operators import event as ev
from paddock.operators import form as fm
from paddock.operators import venue as vn
from paddock.plans import matrix as mx
from paddock.sources.adapter import star_facts
from paddock.spec import Params, adapter_params

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_several_ewmas_share_two_sorts(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, 1.0, 7.0, 30.0]), rng.choice([None, 0.0, 1.0])) for k in (1, 2, None) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, i long, x double, y double")
    got = fm.ewma_priors(df, {"x": "ex", "y": "ey"}, ["k"], ["i"], 0.4)
    assert _plan(got).count("Sort [") == 2 and _plan(fm.ewma_prior(df, "x", ["k"], ["i"], 0.4, "e")).count("Sort [") == 2
    state, want = {}, {}
    for k, i, *values in rows:
        for name, v in zip(("ex", "ey"), values, strict=True):
            num, den = state.get((k, name), (0.0, 0.0))
            want[k, i, name] = num / den if den else None
            state[k, name] = (num * 0.6 + (v or 0.0), den * 0.6 + (v is not None))
    for r in got.collect():
        for name in ("ex", "ey"):
            assert (r[name] is None) == (want[r.k, r.i, name] is None)
            assert r[name] is None or math.isclose(r[name], want[r.k, r.i, name], rel_tol=1e-9, abs_tol=1e-12)


def test_past_ranks_come_from_counts_by_value(spark):
    """Equal to ranking each window's copied rows, and rows are copied to their windows after every join and window."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 2000, 2001, 2002, 2004, 2005, 2009]),
             rng.choice([None, float("nan"), *map(float, range(12))]), rng.choice([None, *map(float, range(30))]))
            for _ in range(1500)] + [("c", y, 3.0, float(i)) for y in (2001, 2002) for i in range(4)]
    df = spark.createDataFrame(rows, "circuitId string, season long, grid double, positionOrder double")
    got = vn._past_correlation(df, Params(), vn.DEFAULT_SPEC)
    plan = _plan(got)
    assert "Window" not in plan[:plan.index("Generate")] and "Join" not in plan[:plan.index("Generate")]
    copies = df.withColumn("t", F.explode(F.sequence(F.col("season") + 1, F.col("season") + 5)))
    want = {(r.circuitId, r.t): r.rho for r in vn.spearman(copies, ["circuitId", "t"], "grid", "positionOrder").collect()
            if r.circuitId is not None and r.t in {y for _, y, _, _ in rows}}
    found = {(r.circuitId, r.season): r._rho for r in got.collect()}
    assert set(found) == set(want) and found["c", 2002] is None
    assert all((found[k] is None) == (v is None) and (v is None or math.isclose(found[k], v, rel_tol=1e-9))
               for k, v in want.items())


def test_peer_values_sort_only_near_rows(spark):
    """Ties, null outcomes and repeated rows; the rows meet written values, without an aggregate over whole keys."""
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(9)}", f"t{rng.randrange(3)}" if rng.random() < 0.9 else None, f"d{rng.randrange(6)}",
             rng.choice([None, 1.0, 1.0, 2.0, 3.0, float("nan")]), rng.choice([None, 5.0, 6.0])) for _ in range(150)]
    df = spark.createDataFrame([*rows, *rows[:40]], "raceId string, constructorId string, driverId string, "
                               "positionOrder double, v double")
    got = ev.peer_first_values(df, ["v"])
    assert "Aggregate" not in _plan(got) and got.count() == len(rows) + 40

    def key(r):
        nan = r[3] is not None and math.isnan(r[3])
        return (r[3] is None, nan, 0.0 if nan or r[3] is None else r[3], r[2], r[4])

    for r in got.collect():
        mates = sorted({key(m) for m in rows if m[0] == r[0] and m[1] == r.constructorId and m[1] is not None and m[4] is not None})
        own = key((r.raceId, r.constructorId, r.driverId, r.positionOrder, r.v)) if r.v is not None else None
        first = mates[1:] if mates and own == mates[0] else mates
        assert r.v_tm == (first[0][-1] if first else None)


def test_feature_rows_are_shuffled_by_history_and_entry_only(spark):
    """Small tables by event, team, period and venue are broadcast: the rows are not shuffled by few keys."""
    plan = _plan(mx.feature_table(*star_facts(spark, SF), adapter_params()))
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keys = [line.split("hashpartitioning(")[1].split(", ")[0].split("#")[0] for line in wide]
    assert not {"season", "round", "circuitId"} & set(keys) and keys.count("driverId") == 1


@pytest.mark.parametrize("split_rows", [0, 60])
def test_ranks_with_several_sums(spark, split_rows):
    from paddock.functions.ranking import Rank, distributed_ranks
    df = spark.range(3000).selectExpr("id", "id % 2 AS g", "hash(id) % 50 AS x", "id % 7 AS v", "id % 3 AS w")
    got = distributed_ranks(df, [Rank(["g"], [("x", True)], "r", ("v", "sv"), (("w", "sw"),))], split_rows=split_rows)
    upto = Window.partitionBy("g").orderBy("x")
    want = df.select("*", F.rank().over(upto).cast("bigint"), F.sum("v").over(upto), F.sum("w").over(upto))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_both_splits_read_one_written_feature_table(spark):
    train, test = se._split(spark, SF)
    assert {f.rpartition("/")[0] for f in train.inputFiles()} == {f.rpartition("/")[0] for f in test.inputFiles()}
    assert train.filter(F.col("season") >= se.P.test_period).isEmpty() and not test.isEmpty()


def test_model_sweep_derives_its_facts_once(spark, monkeypatch):
    calls, seen = [], []
    monkeypatch.setattr(se, "star_facts", lambda *a: calls.append(1) or star_facts(*a))
    monkeypatch.setattr(se.vd, "sweep_models", lambda matrix, entries, *a, **k: seen.append(1) or entries.limit(0).selectExpr(
        "1L combo_id", "1D off_season_decay", "1D regulation_reset_decay", "1L summer_break_round", "1L folds", "1L same_as",
        "1D mean_exp_pts_err"))
    assert se.q_sweep_models(spark, SF).isEmpty() and seen and len(calls) == 1


def test_constant_slots_do_not_change_the_trees(spark):
    from pyspark.ml.regression import GBTRegressor

    from paddock.plans import models as md
    df = spark.range(400).selectExpr("id", "cast(hash(id) % 50 AS double) a", "IF(id % 9 = 0, null, cast(id % 17 AS double)) b",
                                     "3.0D c", "cast(hash(id) % 50 + id % 17 AS double) _label")
    data = md.assemble(df, ["a", "b", "c"], keep=["id", "_label"])
    learner = GBTRegressor(featuresCol="features", labelCol="_label", maxIter=4, maxDepth=3, seed=1)
    whole, sliced = learner.fit(data), md.fit_varying(learner, data)
    assert sliced.slots == [0, 2, 3] and sliced.size == 6
    assert sliced.featureImportances.toArray().tolist() == pytest.approx(whole.featureImportances.toArray().tolist())
    rows = zip(*(m.transform(data).orderBy("id").select("prediction").collect() for m in (whole, sliced)), strict=True)
    assert all(math.isclose(a[0], b[0], rel_tol=1e-12) for a, b in rows)
    assert "_slots" not in sliced.transform(data).columns
    trees = [m.toDebugString.split("\n", 1)[1] for m in (whole, sliced)]
    assert trees[0] == trees[1]
