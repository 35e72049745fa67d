"""Operators on small hand-written panels, checked against pandas
expressions with the reference's public semantics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paddock.operators import event as ev
from paddock.operators import form as fm
from paddock.operators import reliability as rl
from paddock.operators import venue as vn
from paddock.spec import Params

SCHEMA = ("raceId string, season long, round long, circuitId string, driverId string, "
          "constructorId string, grid double, positionOrder double, points double, status string, "
          "driver_best_q_ms double")


def _panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ewma_prior_matches_pandas(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in enumerate([1, 5, 120, 300]):
        for i in range(n):
            v = float(rng.integers(1, 25)) if rng.random() > 0.25 else None
            if k == 3 and 50 < i < 200:
                v = None  # a long run of nulls
            rows.append((k, i, v))
    pdf = pd.DataFrame(rows, columns=["k", "i", "x"])
    exp = pdf.groupby("k")["x"].transform(lambda s: s.shift(1).ewm(alpha=0.4, min_periods=1).mean())
    df = spark.createDataFrame(rows, "k long, i long, x double")
    got = fm.ewma_prior(df, "x", ["k"], ["i"], 0.4, "e").toPandas() \
        .sort_values(["k", "i"])["e"].to_numpy(dtype=float)
    e = exp.to_numpy(dtype=float)
    assert (np.isnan(got) == np.isnan(e)).all()
    assert np.nanmax(np.abs(got - e)) < 1e-9


def test_ewma_prior_of_large_values_over_long_histories(spark):
    rng = np.random.default_rng(3)
    for alpha in (0.4, 0.05, 0.9):
        x = 5e8 + rng.integers(0, 1000, 3000).astype(float)
        exp = pd.Series(x).shift(1).ewm(alpha=alpha).mean().to_numpy()
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, i long, x double")
        got = fm.ewma_prior(df, "x", ["k"], ["i"], alpha, "e").toPandas().sort_values("i")["e"].to_numpy(dtype=float)
        assert np.isnan(got[0]) and np.allclose(got[1:], exp[1:], rtol=1e-12)


def test_ewma_prior_splits_a_huge_history(spark):
    """One history holds 60 % of the rows, with nulls, long runs of nulls, a null key and null order keys: equal to
    the plain windows, and no task of the result holds much of it."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in ((1, 30_000), (None, 8_000), (2, 11_999), (3, 1)):
        for i in range(n):
            gap = rng.random() < 0.2 or (k == 1 and (9_000 < i < 16_000 or i < 700))
            rows.append((k, i if i != 5 else None, None if gap else float(rng.integers(1, 25))))
    df = spark.createDataFrame(rows, "k long, i long, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for alpha in (0.4, 0.05, 0.9, 0.0005, 1.0, 0.0):
            plain = fm.ewma_prior(df, "x", ["k"], ["i"], alpha, "e").selectExpr("k", "i", "x", "e")
            split = fm.ewma_prior(df, "x", ["k"], ["i"], alpha, "e2", skew_safe=True, split_rows=5_000)
            both = plain.join(split.withColumnsRenamed({"k": "k2", "i": "i2", "x": "x2"}), F.expr("k <=> k2 AND i <=> i2"))
            n, unlike, worst = both.agg(F.count(F.lit(1)), F.count_if(F.expr("(e IS NULL) <> (e2 IS NULL)")),
                                        F.max(F.abs(F.col("e") - F.col("e2")))).first()
            assert (n, unlike) == (len(rows), 0) and worst < 1e-9, alpha
        split = fm.ewma_prior(df, "x", ["k"], ["i"], 0.4, "e", skew_safe=True, split_rows=5_000)
        sizes = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 2 and max(sizes) < 0.35 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = fm.ewma_prior(df, "x", ["k"], ["i"], 0.4, "e", skew_safe=True)
    assert same.columns == ["k", "i", "x", "e"] and same.count() == len(rows)


def test_peer_values_per_column_first_non_null(spark):
    # three-car team, first mate has a null time: next non-null per column (Q9)
    rows = [("r1", 2020, 1, "c", "a", "t", 1.0, 1.0, 25.0, "Finished", None),
            ("r1", 2020, 1, "c", "b", "t", 2.0, 2.0, 18.0, "Finished", 90000.0),
            ("r1", 2020, 1, "c", "d", "t", 3.0, 3.0, 15.0, "Finished", 91000.0),
            ("r1", 2020, 1, "c", "e", "u", 4.0, 4.0, 12.0, "Finished", 92000.0)]
    df = ev.peer_first_values(_panel(spark, rows), ["driver_best_q_ms", "positionOrder"])
    got = {r.driverId: (r.driver_best_q_ms_tm, r.positionOrder_tm) for r in df.collect()}
    assert got["a"] == (90000.0, 2.0)
    assert got["b"] == (91000.0, 1.0)
    assert got["d"] == (90000.0, 1.0)
    assert got["e"] == (None, None)


def test_pace_fill_chain_and_h2h(spark):
    p = Params()
    rows = [("r1", 2020, 1, "c", "a", "t", 1.0, 1.0, 25.0, "Finished", 100.0),
            ("r1", 2020, 1, "c", "b", "t", 2.0, 2.0, 18.0, "Finished", None),     # mate has time
            ("r1", 2020, 1, "c", "d", "u", 3.0, 16.0, 0.0, "Finished", None),     # single car, no time
            ("r1", 2020, 1, "c", "x", "v", 5.0, 17.0, 0.0, "Finished", 110.0),
            ("r1", 2020, 1, "c", "y", "v", 6.0, 18.0, 0.0, "Finished", 120.0),
            ("r2", 2020, 2, "c", "a", "t", 1.0, 1.0, 25.0, "Finished", None)]    # nobody timed
    df = ev.pace_features(_panel(spark, rows), p)
    got = {(r.raceId, r.driverId): r for r in df.collect()}
    assert got[("r1", "a")].pace_delta_pct == 0.0
    assert got[("r1", "b")].pace_delta_pct == 1.0          # mate 0.0 + 1.0
    assert abs(got[("r1", "d")].pace_delta_pct - 21.0) < 1e-9  # race max 20 + 1
    assert got[("r2", "a")].pace_delta_pct == 5.0
    assert got[("r1", "a")].teammate_delta_pct == -1.5     # own present, mate missing
    assert got[("r1", "b")].teammate_delta_pct == 1.5
    assert got[("r1", "d")].teammate_delta_pct == 0.0
    assert got[("r1", "d")].h2h_win == 0.0                 # no mate beyond 15th: still 0 (Q8)
    assert got[("r1", "x")].h2h_win == 0.5                 # both beyond 15th
    assert got[("r1", "a")].h2h_win == 1.0


def test_points_lag_null_resets(spark):
    # cumsum then shift: a null row leaves 0 for the next lag (Q10)
    rows = [("r%d" % i, 2020, i, "c", "a", "t", 1.0, 1.0, pts, "Finished", None)
            for i, pts in enumerate([10.0, None, 5.0, 3.0], start=1)]
    df = fm.weekend_reward(_panel(spark, rows).withColumn("sprint_points", F.lit(None).cast("double")))
    got = [r.driver_pts_lag for r in fm.driver_points_lag(df).orderBy("round").collect()]
    assert got == [0.0, 10.0, 0.0, 15.0]


def test_rolling_rates_rows_vs_events(spark):
    p = Params(reliability_window=2)
    rows = []
    for rnd in range(1, 5):
        for d, pos in (("a", 1.0), ("b", 2.0)):
            status = "Retired" if (rnd, d) in ((1, "a"), (2, "b")) else "Finished"
            rows.append((f"r{rnd}", 2020, rnd, "c", d, "t", pos, pos, 0.0, status, None))
    df = _panel(spark, rows).withColumn("is_dnf", F.when(F.col("status") == "Retired", 1).otherwise(0))
    rows_mode = {(r.raceId, r.driverId): r.rate
                 for r in rl.rolling_prior_rate(df, ["constructorId"], "is_dnf", "rate", p, mode="rows").collect()}
    ev_mode = {(r.raceId, r.driverId): r.rate
               for r in rl.rolling_prior_rate(df, ["constructorId"], "is_dnf", "rate", p, mode="events").collect()}
    # rows mode sees the team-mate of the same event that comes earlier
    assert rows_mode[("r1", "a")] is None
    assert rows_mode[("r1", "b")] == 1.0
    assert rows_mode[("r2", "a")] == 0.5
    assert rows_mode[("r3", "b")] == 0.5
    # events mode: both cars of an event get the same leak-free value
    assert ev_mode[("r1", "a")] is None and ev_mode[("r1", "b")] is None
    assert ev_mode[("r2", "a")] == ev_mode[("r2", "b")] == 0.5
    assert ev_mode[("r3", "a")] == 0.5


def test_rows_mode_matches_plain_window(spark):
    rng = np.random.default_rng(3)
    rows = []
    for rnd in range(1, 30):
        for d in range(int(rng.integers(1, 6))):
            rows.append((f"r{rnd}", 2000 + rnd // 10, rnd, "c", f"d{d}", "t" + str(d % 2), 0.0, float(d + 1),
                         0.0, "x", None))
    df = _panel(spark, rows).withColumn("is_dnf", (F.rand(5) > 0.7).cast("int")).cache()
    p = Params(reliability_window=4)
    got = rl.rolling_prior_rate(df, ["constructorId"], "is_dnf", "rate", p, mode="rows")
    from pyspark.sql import Window
    w = Window.partitionBy("constructorId").orderBy("season", "round", "positionOrder", "driverId")
    exp = df.select("raceId", "driverId", F.avg("is_dnf").over(w.rowsBetween(-4, -1)).alias("exp"))
    bad = got.join(exp, ["raceId", "driverId"]).filter(~F.col("rate").eqNullSafe(F.col("exp"))).count()
    assert bad == 0


def test_spearman_edges(spark):
    rows = [("g1", 1.0, 1.0), ("g1", 2.0, 3.0), ("g1", 2.0, 2.0), ("g1", 4.0, None),
            ("g2", 1.0, 5.0), ("g2", 1.0, 6.0),                    # constant side -> null
            ("g3", 1.0, 1.0)]                                      # single pair -> null
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r.g: r.rho for r in vn.spearman(df, ["g"], "a", "b").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "a", "b"])
    exp = pdf[pdf.g == "g1"][["a", "b"]].dropna().rank().corr().iloc[0, 1]
    assert math.isclose(got["g1"], exp, rel_tol=1e-12)
    assert got["g2"] is None and got["g3"] is None


def test_venue_retention_thresholds(spark):
    p = Params()
    rows = []
    # venue c: 2 rows per season 2014..2019 (4 past rows in 2016: below both thresholds)
    for season in range(2014, 2021):
        for d, (g, pos) in enumerate([(1.0, 1.0), (2.0, 2.0)]):
            rows.append((f"{season}_1", season, 1, "c", f"d{d}", "t", g, pos, 0.0, "Finished", None))
    df = _panel(spark, rows)
    got = {r.season: r for r in vn.venue_retention(df, p).collect()}
    assert got[2014].track_retention_confidence == 0.0
    assert got[2016].track_retention_confidence == 0.4
    assert got[2020].track_retention_confidence == 1.0
    # 2016: 4 past rows -> global mean g; global mean over pairs with >= 5 rows
    g = vn.global_retention(vn.retention_inputs(df, p), p).first()[0]
    assert got[2016].track_retention_idx == pytest.approx(g)
    assert got[2020].track_retention_idx == pytest.approx(1.0)


def test_peer_aggregate_equals_window(spark):
    rng = np.random.default_rng(11)
    rows = []
    for rnd in range(12):
        for d in range(int(rng.integers(1, 9))):
            t = float(rng.integers(1000, 2000)) if rng.random() > 0.4 else None
            pos = float(d + 1) if rng.random() > 0.1 else None
            rows.append((f"r{rnd}", 2020, rnd, "c", f"d{d}", f"t{int(rng.integers(0, 3))}", 0.0, pos, 0.0, "x", t))
    df = _panel(spark, rows)
    cols = ["driver_best_q_ms", "positionOrder"]
    a = ev.peer_first_values(df, cols, method="aggregate").select("raceId", "driverId", "driver_best_q_ms_tm",
                                                                  "positionOrder_tm")
    w = ev.peer_first_values(df, cols, method="window").select("raceId", "driverId", "driver_best_q_ms_tm",
                                                               "positionOrder_tm")
    assert a.exceptAll(w).count() == 0 and w.exceptAll(a).count() == 0


def test_distributed_rank_equals_rank_when_groups_are_split(spark):
    from pyspark.sql import Window
    from paddock.functions.ranking import distributed_rank
    rng = np.random.default_rng(5)
    rows = [(None if g == "n" else g, None if rng.random() < 0.05 else float(rng.integers(0, 60)),
             float("nan") if rng.random() < 0.03 else float(rng.normal()), i, int(rng.integers(0, 5)))
            for i, g in enumerate(["a"] * 900 + ["b"] * 40 + ["n"] * 300 + ["c"])]
    df = spark.createDataFrame(rows, "g string, x double, y double, i long, v long").repartition(5)
    for order in ([("x", True)], [("x", False)], [("x", False), ("i", True)], [("y", False), ("x", True)]):
        w = Window.partitionBy("g").orderBy(*[F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last()
                                              for c, a in order])
        want = df.select("i", F.rank().over(w).cast("bigint").alias("r"), F.sum("v").over(
            w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("s"))
        for split in (50, 10**6):
            got = distributed_rank(df, ["g"], order, "r", cumulative=("v", "s"), split_rows=split).select("i", "r", "s")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (order, split)


def test_several_ranks_split_over_several_groupings(spark):
    import random

    from paddock.functions.ranking import Rank, distributed_ranks
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.choice([True, False, None]),
             rng.choice([None, *range(40)]), rng.choice([None, float("nan"), *map(float, range(9))]), rng.randrange(5))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, f boolean, x long, y double, v long")
    ranks = [Rank(["g"], [("x", True), ("i", False)], "r0", ("v", "s0")), Rank(["g", "f"], [("y", False)], "r1"),
             Rank(["f"], [("x", False)], "r2", ("v", "s2")), Rank([], [("y", True)], "r3")]
    want = distributed_ranks(df, ranks).orderBy("i").collect()
    for split in (0, 50, 700):
        got = distributed_ranks(df, ranks, split_rows=split).orderBy("i")
        assert [str(r) for r in got.collect()] == [str(r) for r in want]
    ties = df.selectExpr("i", "rank() OVER (PARTITION BY g ORDER BY x NULLS LAST, i DESC) r0",
                         "rank() OVER (PARTITION BY g, f ORDER BY y DESC NULLS LAST) r1").orderBy("i").collect()
    assert [(r.r0, r.r1) for r in want] == [(r.r0, r.r1) for r in ties]


def test_three_ranks_read_a_table_once(spark, tmp_path):
    from paddock.functions.ranking import Rank, distributed_ranks
    spark.range(5000).selectExpr("id", "id % 2 AS g", "id % 91 AS a", "id % 83 AS b", "id % 7 AS c").write.parquet(
        str(tmp_path / "t"))
    ranks = [Rank(["g"], [(c, True)], f"r{c}") for c in "abc"]
    for split in (100_000, 500):
        out = distributed_ranks(spark.read.parquet(str(tmp_path / "t")), ranks, split_rows=split)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReadSchema: struct<id:bigint") == 1
        assert out.filter("ra > 0").count() == 5000


def test_global_median_by_bits_equals_a_sort(spark):
    import random
    import statistics

    from paddock.operators.form import global_median
    from paddock.spec import Params
    rng = random.Random(1)
    sets = [[], [5.0], [1.0, 2.0], [-0.0, 0.0, 3.0], [-1.5, -1.5, 2.0], [float("-inf"), 4.0, float("inf")],
            [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(1001)],
            [float(rng.randint(-3, 3)) for _ in range(500)], [1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51, 1.0 + 2 ** -50]]
    for values in sets:
        rows = [(v,) for v in [*values, None, float("nan")]]
        got = global_median(spark.createDataFrame(rows, "positionOrder double"), "positionOrder", Params()).collect()
        assert len(got) == 1 and got[0][0] == (statistics.median(values) if values else None)
