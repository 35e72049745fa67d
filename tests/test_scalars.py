"""Scalar functions on hand-written rows (FIXTURES edge table)."""

from pyspark.sql import functions as F

from paddock.functions import scalars as sc
from paddock.spec import Params


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_lap_time_ms(spark):
    got = _one(spark, sc.lap_time_ms, ["1:23.456", "23.456", "\\N", "", None, "a:b", "1:2:3", "3D", " 7 "])
    assert got[0] == 83456.0 or abs(got[0] - 83456.0) < 1e-9
    assert abs(got[1] - 23456.0) < 1e-9
    assert got[2:8] == [None, None, None, None, None, None]
    assert got[8] == 7000.0


def test_to_number_rejects_suffixes(spark):
    got = _one(spark, sc.to_number, ["R", "\\N", "3D", "3", " 3 ", "1e3", "nan", "-2.5"])
    assert got == [None, None, None, 3.0, 3.0, 1000.0, None, -2.5]


def test_best_of_skips_nulls(spark):
    df = spark.createDataFrame([(None, 2.0, 1.5), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(sc.best_of("a", "b", "c")).collect()] == [1.5, None]


def test_classified_flag_case_sensitive(spark):
    vals = ["Finished", "+1 Lap", "Lapped", "Retired", "Disqualified", None, "finished", "lapped"]
    assert _one(spark, sc.classified_flag, vals) == [1, 1, 1, 0, 0, 0, 0, 0]


def test_non_starter(spark):
    vals = ["Did not start", "dns", "DNS", "Finished", None, "did NOT start"]
    assert _one(spark, sc.non_starter, vals) == [True, True, True, False, False, True]


def test_eras(spark):
    p = Params()
    got = _one(spark, lambda c: sc.era_of(c, p.eras, p.era_default), [2013, 2014, 2021, 2022, 2025, 2026], "int")
    assert got == ["2026_Reset", "V6_Hybrid_v1", "V6_Hybrid_v1", "Ground_Effect", "Ground_Effect", "2026_Reset"]


def test_supplier_rules(spark):
    p = Params()
    rows = [("mclaren", 2014), ("mclaren", 2015), ("mclaren", 2018), ("mclaren", 2021),
            ("sauber", 2025), ("sauber", 2026), ("sauber", 2027), ("unknown", 2020), (None, 2020),
            ("McLaren", 2014)]
    df = spark.createDataFrame(rows, "team string, season int")
    got = [r[0] for r in df.select(sc.map_by_period_rules("team", "season", p.supplier_rules,
                                                          p.supplier_default)).collect()]
    assert got == ["mercedes", "honda_rbpt", "renault", "mercedes", "ferrari", "audi", "ferrari", "other",
                   "other", "mercedes"]


def test_relevance_and_points(spark):
    vals = [1.0, 2.9, 10.0, 20.0, 21.0, None]
    assert _one(spark, sc.relevance_of, vals, "double") == [2500, 1800, 100, 2, 1, 1]
    assert _one(spark, sc.points_of, vals, "double") == [25.0, 18.0, 1.0, 0.0, 0.0, 0.0]


def test_event_key_and_int(spark):
    df = spark.createDataFrame([("2020", "3"), ("x", "4")], "s string, r string")
    got = df.select(sc.event_key(sc.to_int("s", 0), sc.to_int("r", 0))).collect()
    assert [r[0] for r in got] == ["2020_3", "0_4"]
