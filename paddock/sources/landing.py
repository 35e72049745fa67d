"""Land fact tables as nested JSON pages (the raw landing format).

Used to exercise the raw readers on data derived from the given tables and
as the batch source for incremental ingestion tests. Each endpoint is cut
into pages of ``page_size`` rows in entry order; a page is one JSON object
with its name, many pages to a file, in a folder per kind of page. Pages are
the unit of grouping, so no group exceeds ``page_size`` rows, and positions
come from the skew-safe row number, so no window spans a large event.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import distributed_row_number
from .adapter import lap_string
from .raw import KINDS, landing_paths


def _num_str(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _paginate(df: DataFrame, group: list[str], order: list[str], elem: Column, page_size: int) -> DataFrame:
    tot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
    x = distributed_row_number(df, group, [(c, True) for c in order], "_i").withColumn("_i", F.col("_i") - 1)
    x = x.withColumn("_page", F.floor(F.col("_i") / page_size).cast("bigint")) \
          .join(tot, group, "left")
    pages = x.groupBy(*group, "_page", "_total").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_i"), elem.alias("e")))).alias("_items"))
    return pages.withColumn("_items", F.transform("_items", lambda s: s["e"]))


def _race_pages(df: DataFrame, kind: str, array_name: str, elem: Column, page_size: int,
                circuit: bool = False, skip: Column | None = None, suffix: str = "") -> DataFrame:
    group = ["season", "round"] + (["circuitId"] if circuit else [])
    p = _paginate(df, group, ["_ord", "driverId"], elem, page_size)
    if skip is not None:
        p = p.filter(~skip)
    race_fields = [F.col("season").cast("string").alias("season"), F.col("round").cast("string").alias("round")]
    if circuit:
        race_fields.append(F.struct(F.col("circuitId").alias("circuitId")).alias("Circuit"))
    race = F.struct(*race_fields, F.col("_items").alias(array_name))
    name = F.concat(F.lit("race_"), F.col("season").cast("string"), F.lit("_"), F.col("round").cast("string"),
                    F.lit(f"_{kind}{suffix}_offset_"), (F.col("_page") * page_size).cast("string"))
    return p.select(name.alias("page"), F.struct(
        F.col("_total").cast("string").alias("total"),
        F.struct(F.array(race).alias("Races")).alias("RaceTable")).alias("MRData"))


def result_pages(results: DataFrame, page_size: int = 100, skip: Column | None = None) -> DataFrame:
    elem = F.struct(
        F.struct(F.col("driverId").alias("driverId")).alias("Driver"),
        F.struct(F.col("constructorId").alias("constructorId")).alias("Constructor"),
        _num_str(F.col("grid")).alias("grid"), _num_str(F.col("positionOrder")).alias("position"),
        _num_str(F.col("points")).alias("points"), F.col("status").alias("status"))
    df = results.withColumn("_ord", F.col("positionOrder"))
    return _race_pages(df, "results", "Results", elem, page_size, circuit=True, skip=skip)


def soiled(results: DataFrame) -> DataFrame:
    """Results as strings with the dirt of real pages, by entity, period and round: null and ``\\N`` points,
    positions, status and start positions, non-starters, entries that come again on a later page (``again``) and
    entries without an id. The same derivation is ``SOILED_SQL``."""
    kind = (F.regexp_extract("driverId", "[0-9]+", 0).cast("bigint") * 7 + F.col("season") * 3 + F.col("round")) % 13
    null = F.lit(None).cast("string")
    return results.withColumn("_kind", kind).select(
        "raceId", "season", "round", "circuitId", "constructorId", "_kind", F.col("driverId").alias("_ord"),
        F.when(F.col("_kind") != 6, F.col("driverId")).alias("driverId"),
        F.when(F.col("_kind") == 4, "R").when(F.col("_kind") == 8, "").otherwise(_num_str(F.col("grid"))).alias("grid"),
        F.when(F.col("_kind") == 1, null).otherwise(_num_str(F.col("positionOrder"))).alias("position"),
        F.when(F.col("_kind") == 0, "\\N").otherwise(_num_str(F.col("points"))).alias("points"),
        F.when(F.col("_kind") == 2, null).when(F.col("_kind") == 3, "DNS").when(F.col("_kind") == 7, "\\N")
        .otherwise(F.col("status")).alias("status"), (F.col("_kind") == 5).alias("again"))


SOILED_SQL = """
soiled AS (
  SELECT raceId, season, round, circuitId, constructorId, kind, CASE WHEN kind <> 6 THEN driverId END AS driverId,
         CASE WHEN kind NOT IN (4, 8) THEN grid END AS grid, CASE WHEN kind <> 1 THEN positionOrder END AS positionOrder,
         CASE WHEN kind <> 0 THEN points END AS points,
         CASE WHEN kind IN (2, 7) THEN NULL WHEN kind = 3 THEN 'DNS' ELSE status END AS status
  FROM (SELECT *, (CAST(substr(driverId, 2) AS BIGINT) * 7 + season * 3 + round) % 13 AS kind FROM fact_results)
)"""


def land_soiled(results: DataFrame, root: str, page_size: int = 100) -> None:
    """Results pages with dirt: pages of ``soiled`` rows, later pages that repeat some entries with other points,
    and one cut-off page per event of every fifth round."""
    rows = soiled(results)
    elem = F.struct(
        F.struct(F.col("driverId").alias("driverId")).alias("Driver"),
        F.struct(F.col("constructorId").alias("constructorId")).alias("Constructor"), "grid", "position", "points", "status")
    write_pages(_race_pages(rows, "results", "Results", elem, page_size, circuit=True), root, "results")
    late = rows.filter("again").withColumn("points", F.lit("999"))
    write_pages(_race_pages(late, "results", "Results", elem, page_size, circuit=True, suffix="_repeat"), root, "results")
    cut = results.filter(F.col("round") % 5 == 0).select("raceId").distinct().select(
        F.concat(F.lit('{"page":"race_'), "raceId", F.lit('_results_offset_0","MRData":{"total":"1')))
    cut.write.mode("append").text(landing_paths(root, "results")[0])


def qualifying_pages(qualifying: DataFrame, events: DataFrame, page_size: int = 100,
                     skip: Column | None = None) -> DataFrame:
    """``events`` maps raceId -> season, round."""
    q = qualifying.join(events.select("raceId", "season", "round").distinct(), "raceId")

    def lap(c):
        return F.when(F.col(c).isNotNull(), lap_string(F.col(c).cast("bigint")))

    elem = F.struct(
        F.struct(F.col("driverId").alias("driverId")).alias("Driver"),
        _num_str(F.col("qualifying_pos")).alias("position"),
        lap("q1_ms").alias("Q1"), lap("q2_ms").alias("Q2"), lap("q3_ms").alias("Q3"))
    return _race_pages(q.withColumn("_ord", F.col("qualifying_pos")), "qualifying", "QualifyingResults",
                       elem, page_size, skip=skip)


def sprint_pages(sprints: DataFrame, events: DataFrame, page_size: int = 100,
                 skip: Column | None = None) -> DataFrame:
    s = sprints.join(events.select("raceId", "season", "round").distinct(), "raceId")
    elem = F.struct(
        F.struct(F.col("driverId").alias("driverId")).alias("Driver"),
        _num_str(F.col("sprint_finish")).alias("position"), _num_str(F.col("sprint_points")).alias("points"))
    return _race_pages(s.withColumn("_ord", F.col("sprint_finish")), "sprint", "SprintResults", elem, page_size, skip=skip)


def listing_pages(results: DataFrame, entity: str, prefix: str, table: str, array: str,
                  page_size: int = 100) -> DataFrame:
    """Listing pages ``<prefix>_<season>``: distinct ids of a column per period."""
    d = results.select("season", F.col(entity)).distinct()
    p = _paginate(d, ["season"], [entity], F.struct(F.col(entity).alias(entity)), page_size)
    name = F.concat(F.lit(f"{prefix}_"), F.col("season").cast("string"), F.lit("_offset_"),
                    (F.col("_page") * page_size).cast("string"))
    return p.select(name.alias("page"), F.struct(
        F.col("_total").cast("string").alias("total"),
        F.struct(F.col("_items").alias(array)).alias(table)).alias("MRData"))


def driver_listing_pages(results: DataFrame, page_size: int = 100) -> DataFrame:
    return listing_pages(results, "driverId", "active_drivers", "DriverTable", "Drivers", page_size)


def constructor_listing_pages(results: DataFrame, page_size: int = 100) -> DataFrame:
    return listing_pages(results, "constructorId", "active_constructors", "ConstructorTable", "Constructors", page_size)


def race_list_pages(results: DataFrame, page_size: int = 100) -> DataFrame:
    """Pages ``driver_<id>_races``: the events of each entity. The events of even rounds come again on pages
    ``driver_<id>_races_repeat``, so lists overlap within an entity as well as between entities."""
    events = results.select("driverId", "season", "round").distinct()

    def listed(rows: DataFrame, suffix: str) -> DataFrame:
        elem = F.struct(F.col("season").cast("string").alias("season"), F.col("round").cast("string").alias("round"))
        p = _paginate(rows, ["driverId"], ["season", "round"], elem, page_size)
        name = F.concat(F.lit("driver_"), "driverId", F.lit(f"_races{suffix}_offset_"),
                        (F.col("_page") * page_size).cast("string"))
        return p.select(name.alias("page"), F.struct(F.col("_total").cast("string").alias("total"), F.struct(
            F.col("_items").alias("Races")).alias("RaceTable")).alias("MRData"))

    return listed(events, "").unionByName(listed(events.filter(F.col("round") % 2 == 0), "_repeat"))


def write_pages(pages: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """Page files of one kind: one page a line, as many pages a file as a task has."""
    pages.write.mode(mode).json(landing_paths(root, kind)[0])


def land_facts(results: DataFrame, qualifying: DataFrame, sprints: DataFrame, root: str,
               page_size: int = 100, kinds: Iterable[str] = KINDS, skip: Column | None = None) -> None:
    """Land the wanted kinds of pages of all events under ``root``. Pages for
    which ``skip`` (over ``_page``, the page's number) holds are left out."""
    events = results.select("raceId", "season", "round").distinct()
    made = {"results": lambda: result_pages(results, page_size, skip),
            "qualifying": lambda: qualifying_pages(qualifying, events, page_size, skip),
            "sprint": lambda: sprint_pages(sprints, events, page_size, skip),
            "driver_races": lambda: race_list_pages(results, page_size),
            "active_drivers": lambda: driver_listing_pages(results, page_size),
            "active_constructors": lambda: constructor_listing_pages(results, page_size)}
    for kind in kinds:
        write_pages(made[kind](), root, kind)
