"""Raw pages, landing audit, parameter artifact and streaming ingest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from paddock.session import scratch_path
from paddock.sources import raw
from paddock.spec import Params


def _page(races, total="1"):
    return {"MRData": {"total": total, "RaceTable": {"Races": races}}}


def _write(folder, name, obj):
    with open(os.path.join(folder, name), "w") as f:
        json.dump(obj, f, indent=2)  # multi-line object, as landed


def test_parse_results_edges_and_keep_first(spark, tmp_path):
    d = str(tmp_path)
    res = [
        {"Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}, "grid": "1", "position": "2",
         "points": "18", "status": "Finished"},
        {"Driver": {"driverId": "b"}, "Constructor": {"constructorId": "t"}, "grid": "\\N", "position": "R",
         "points": "3D", "status": "\\N"},
    ]
    _write(d, "race_2020_1_results_offset_0.json",
           _page([{"season": "2020", "round": "1", "Circuit": {"circuitId": "x"}, "Results": res}]))
    # a later file repeats driver a with other values: the first file wins
    dup = [dict(res[0], grid="9")]
    _write(d, "race_2020_1_results_offset_100.json",
           _page([{"season": "2020", "round": "1", "Circuit": {"circuitId": "x"}, "Results": dup}]))
    # old season is dropped; a race with no results yields no row
    _write(d, "race_2013_1_results_offset_0.json",
           _page([{"season": "2013", "round": "1", "Circuit": {"circuitId": "x"}, "Results": res}]))
    _write(d, "race_2020_2_results_offset_0.json", _page([{"season": "2020", "round": "2"}]))
    df = raw.parse_results(raw.read_raw(spark, f"{d}/*results*.json"), Params())
    rows = {r.driverId: r for r in df.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].grid == 1.0 and rows["a"].raceId == "2020_1" and rows["a"].points == 18.0
    assert rows["b"].grid is None and rows["b"].positionOrder is None and rows["b"].points is None
    assert rows["b"].status is None


def test_parse_qualifying_times(spark, tmp_path):
    d = str(tmp_path)
    q = [{"Driver": {"driverId": "a"}, "position": "1", "Q1": "1:23.456", "Q2": "1:22.000"},
         {"Driver": {"driverId": "b"}, "position": "2", "Q1": "\\N", "Q2": "", "Q3": "a:b"}]
    _write(d, "race_2020_1_qualifying_offset_0.json",
           _page([{"season": "2020", "round": "1", "QualifyingResults": q}]))
    rows = {r.driverId: r for r in raw.parse_qualifying(raw.read_raw(spark, f"{d}/*qualifying*.json")).collect()}
    assert abs(rows["a"].q1_ms - 83456.0) < 1e-6 and abs(rows["a"].driver_best_q_ms - 82000.0) < 1e-6
    assert rows["b"].driver_best_q_ms is None


def test_missing_pages_and_pending(spark, tmp_path):
    d = str(tmp_path)
    race = {"season": "2020", "round": "1", "Results": []}
    _write(d, "race_2020_1_results_offset_0.json", _page([race], total="250"))
    _write(d, "race_2020_1_results_offset_200.json", _page([race], total="250"))
    _write(d, "race_2020_1_sprint_offset_0.json", _page([], total="0"))
    landed = raw.read_raw(spark, f"{d}/race_*.json")
    miss = [(r.prefix, r.offset) for r in raw.missing_pages(landed).collect()]
    assert miss == [("race_2020_1_results", 100)]
    events = spark.createDataFrame([(2020, 1), (2020, 2)], "season long, round long")
    pend = sorted((r.season, r.round, r.endpoint) for r in raw.pending_requests(events, landed).collect())
    assert pend == [(2020, 1, "qualifying"), (2020, 2, "qualifying"), (2020, 2, "results"), (2020, 2, "sprint")]


def test_malformed_pages_are_never_lost(spark, tmp_path):
    d = str(tmp_path)
    res = [{"Driver": {"driverId": c}, "Constructor": {"constructorId": "t"}, "grid": "1", "position": "2",
            "points": "18", "status": "Finished"} for c in "ab"]
    race = {"season": "2020", "round": "1", "Circuit": {"circuitId": "x"}, "Results": res + [dict(res[0], Driver={})]}
    _write(d, "race_2020_1_results_offset_0.json", _page([race], total="300"))
    _write(d, "race_2020_1_results_offset_100.json", _page([dict(race, round="2")], total="300"))
    cut = json.dumps(_page([dict(race, round="3")], total="300"))[:-40]
    with open(os.path.join(d, "race_2020_1_results_offset_200.json"), "w") as f:
        f.write(cut)
    pages = raw.read_raw(spark, f"{d}/*.json")
    with pytest.raises(Exception, match="malformed page race_2020_1_results_offset_200"):
        raw.parse_results(pages).collect()
    assert raw.parse_results(pages, on_bad="quarantine").count() == 4  # the entry without an id matches nothing
    assert raw.keyless_rows(raw.explode_results(pages, on_bad="quarantine")).count() == 2
    bad = raw.bad_pages(pages).collect()
    assert [r._file for r in bad] == ["race_2020_1_results_offset_200.json"] and bad[0].text == cut
    assert [(r.prefix, r.offset) for r in raw.missing_pages(pages).collect()] == [("race_2020_1_results", 200)]


def test_unreadable_params_are_an_error(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        raw.load_params(spark, str(tmp_path))


def test_params_roundtrip_and_fallback(spark):
    path = scratch_path(spark, "params")
    p = Params().with_(off_season_decay=0.5, summer_seq=14)
    raw.save_params(spark, p, path)
    got = raw.load_params(spark, path)
    assert got.off_season_decay == 0.5 and got.summer_seq == 14
    assert raw.load_params(spark, path + "-missing") == Params()


def test_stream_equals_batch_and_second_run_adds_nothing(spark):
    from paddock.sources.adapter import star_facts
    from paddock.sources.landing import land_facts
    from paddock.spec import adapter_params
    from paddock.streaming.ingest import ingest_incremental, read_ingested
    p = adapter_params()
    r, q, s = star_facts(spark, "/root/testdata/sf0.001")
    root = scratch_path(spark, "landing")
    first = r.filter(F.col("season") <= 1997)
    land_facts(first, q.limit(0), s.limit(0), root)
    sink, ckpt = scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    glob = raw.landing_paths(root, "results")[0]
    n1 = ingest_incremental(spark, glob, sink, ckpt, p, lines=True)
    # pages of 100 entries: one results page per event at this scale
    # pages below the period floor give no rows and are not counted
    assert n1 == first.filter(F.col("season") >= p.first_period).select("raceId").distinct().count()
    # land the remaining seasons; only those pages are read
    rest = r.filter(F.col("season") > 1997)
    land_facts(rest, q.limit(0), s.limit(0), root)
    n2 = ingest_incremental(spark, glob, sink, ckpt, p, lines=True)
    assert n2 == rest.select("raceId").distinct().count()
    assert ingest_incremental(spark, glob, sink, ckpt, p, lines=True) == 0
    streamed = read_ingested(spark, sink)
    batch = raw.parse_results(raw.read_raw(spark, raw.landing_paths(root, "results"), lines=True), p)
    cols = ["raceId", "driverId", "grid", "positionOrder", "points", "status"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    assert batch.count() == r.filter(F.col("season") >= p.first_period).count() < r.count()


def test_quarantine_counts_what_it_stores_and_loses_no_row(spark, tmp_path):
    d = str(tmp_path / "pages")
    os.makedirs(d)
    res = [{"Driver": {"driverId": c}, "Constructor": {"constructorId": "t"}, "grid": "R", "position": "\\N",
            "points": "18", "status": None} for c in "ab"]
    race = {"season": "2020", "round": "1", "Circuit": {"circuitId": "x"}, "Results": res + [dict(res[0], Driver={})]}
    _write(d, "race_2020_1_results_offset_0.json", _page([race], total="300"))
    _write(d, "race_2020_1_results_offset_100.json", _page([dict(race, Results=[dict(res[1], points="7")])], total="300"))
    _write(d, "race_1900_1_results_offset_0.json", _page([dict(race, season="1900")], total="3"))
    _write(d, "race_2020_2_results_offset_0.json", _page([], total="0"))
    with open(os.path.join(d, "race_2020_3_results_offset_0.json"), "w") as f:
        f.write('{"MRData": {"total": ')
    path = str(tmp_path / "out")
    counts = raw.quarantine_results(raw.read_raw(spark, f"{d}/*.json"), path, Params().with_(first_period=2000))
    assert counts == {"facts": 3, "keyless_rows": 1, "bad_pages": 1}
    facts = sorted(tuple(r) for r in raw.read_quarantined(spark, path, "facts").select(
        "raceId", "driverId", "grid", "positionOrder", "points", "status").collect())
    assert facts == [("2020_1", "a", None, None, 18.0, None), ("2020_1", "b", None, None, 18.0, None)]
    assert raw.read_quarantined(spark, path, "bad_pages").first().text == '{"MRData": {"total": '
    assert raw.quarantine_results(raw.read_raw(spark, f"{d}/*.json").limit(0), path)["facts"] == 0


def test_race_lists_of_active_entities(spark, tmp_path):
    d = str(tmp_path / "pages")
    os.makedirs(d)

    def races(*events):
        return _page([{"season": str(y), "round": str(n)} for y, n in events], total="3")

    _write(d, "driver_a_races_offset_0.json", races((2019, 1), (2020, 1), (2020, 2)))
    _write(d, "driver_a_races_repeat_offset_0.json", races((2020, 2), (2021, 4)))
    _write(d, "driver_b_races_offset_0.json", races((2020, 2), (2020, 3)))
    _write(d, "driver_b_b_races_offset_0.json", races((2022, 9)))
    _write(d, "driver_c_races_offset_0.json", races())
    pages = raw.read_raw(spark, f"{d}/*.json")

    def got(*ids):
        active = spark.createDataFrame([(i,) for i in ids], "id string")
        return sorted(tuple(r) for r in raw.race_list_universe(pages, active, 2020).collect())

    assert got("a", "c", "a") == [(2020, 1), (2020, 2), (2021, 4)]
    assert got("a", "b") == [(2020, 1), (2020, 2), (2020, 3), (2021, 4)]
    assert got("b_b") == [(2022, 9)] and got() == [] and got("c") == []


def _stored_files(table):
    table = table.removeprefix("file://").removeprefix("file:")
    return {os.path.join(p, f) for p, _, names in os.walk(table) for f in names if f.endswith(".parquet")}


def test_merged_table_equals_batch_and_rewrites_touched_events_only(spark):
    from paddock.sources.adapter import star_facts
    from paddock.sources.landing import land_facts
    from paddock.spec import adapter_params
    from paddock.streaming.ingest import ingest_merged, merge_batch, read_merged
    p = adapter_params()
    r, q, s = star_facts(spark, "/root/testdata/sf0.001")
    r = r.filter(F.col("season") >= 1996)
    root, table, ckpt = (scratch_path(spark, n) for n in ("landing", "merged", "ckpt"))
    glob = raw.landing_paths(root, "results")[0]
    land_facts(r.filter(F.col("season") < 1998), q.limit(0), s.limit(0), root, kinds=["results"])
    assert ingest_merged(spark, glob, table, ckpt, p, lines=True) > 0
    before = _stored_files(table)
    assert ingest_merged(spark, glob, table, ckpt, p, lines=True) == 0 and _stored_files(table) == before
    land_facts(r.filter(F.col("season") == 1998), q.limit(0), s.limit(0), root, kinds=["results"])
    assert ingest_merged(spark, glob, table, ckpt, p, lines=True) > 0
    assert before < _stored_files(table)  # nothing of earlier seasons was written again

    pages = raw.read_raw(spark, raw.landing_paths(root, "results"), lines=True)
    batch = raw.parse_results(pages, p)

    def same():
        got = read_merged(spark, table).select(batch.columns)
        return got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()

    assert same() and batch.filter("season = 1998").count() > 0
    # one event again under an id the ledger has not, then under the same id, and a page that sorts first
    flat = raw.explode_results(pages, p).filter("season = 1998 AND round = 1")
    ledger = scratch_path(spark, "ledger")
    merge_batch(spark, flat, 7, table, ledger)
    kept = _stored_files(table)
    merge_batch(spark, flat.withColumn("points", F.lit(0.5)).withColumn("_file", F.lit("a")), 7, table, ledger)
    assert same() and _stored_files(table) == kept
    merge_batch(spark, flat.withColumn("points", F.lit(0.5)).withColumn("_file", F.lit("a")), 8, table, ledger)
    changed = read_merged(spark, table).filter("points = 0.5")
    assert changed.select("season", "round").distinct().collect() == [(1998, 1)] and changed.count() == flat.select(
        "driverId").distinct().count()
