"""Panel adapter over the driver's star-schema tables.

Derives the three fact tables of a ranked-event panel from ``lineitem`` and
``supplier``: an *event* is a (ship year, ship month), an *entity* is a
supplier, its *team* is its nation modulo 10, and the event's *venue* cycles
over six values. Finishing order, start order, status, trial times and a
second ("sprint") ranking in months 4 and 8 are all derived from the line
items, so every downstream feature grows with the input tables.

The same derivation is given as SQL text (``ADAPTER_SQL_CTES``) for the
DuckDB oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import Rank, distributed_ranks
from ..functions.scalars import points_of
from ..session import materialize, table_path
from ..spec import POINTS_BY_POSITION

SPRINT_MONTHS = (4, 8)
VENUES = 6
TEAMS = 10


def _entry_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(table_path(sf_dir, "lineitem"))
    sup = spark.read.parquet(table_path(sf_dir, "supplier")).select("s_suppkey", "s_nationkey")
    # Aggregate line items first (partial aggregation map-side), then attach
    # the supplier's nation: the join sees one row per (month, supplier).
    agg = (
        li.groupBy(
            F.year("l_shipdate").cast("bigint").alias("season"),
            F.month("l_shipdate").cast("bigint").alias("round"),
            F.col("l_suppkey").alias("suppkey"),
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"),
            F.sum("l_linenumber").alias("sumline"),
            F.sum("l_quantity").alias("sumqty"),
            F.min(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("q_best"),
            F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("q_slow"),
        )
    )
    return agg.join(sup, agg.suppkey == sup.s_suppkey, "inner").drop("s_suppkey")


def _status() -> F.Column:
    n, r = F.col("n"), F.col("r")
    return (
        F.when((r == n) & (n == 1), F.lit("Did not start"))
        .when(2 * r > n, F.lit("Retired"))
        .when(r > 0, F.lit("+1 Lap"))
        .otherwise(F.lit("Finished"))
    )


def star_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, qualifying, sprints) fact tables in the canonical schema."""
    base = _entry_aggregates(spark, sf_dir).withColumn(
        "raceId", F.concat_ws("_", F.col("season").cast("string"), F.col("round").cast("string"))
    )
    # not every entry has times, and only some events a second ranking
    base = base.withColumn("_timed", ~((F.col("suppkey") % 7 == 0) & (F.col("round") % 5 == 0))) \
        .withColumn("_sprint", F.col("round").isin(list(SPRINT_MONTHS)))
    # one row per (month, supplier), written once for the four orders
    base = materialize(base, "entry-aggregates")
    # an event here is a calendar month: one key holds ~1/84 of all line
    # items, so per-event orders use the skew-safe ranks (no window over a
    # whole event); (value, supplier key) is unique: row numbers.
    ranked = materialize(distributed_ranks(base, [
        Rank(["raceId"], [("sumline", False), ("suppkey", True)], "_grid"),
        Rank(["raceId"], [("sumqty", False), ("suppkey", True)], "_pos"),
        Rank(["raceId", "_timed"], [("q_best", True), ("suppkey", True)], "_qpos"),
        Rank(["raceId", "_sprint"], [("n", False), ("suppkey", True)], "_spos")]), "ranked-entries")
    results = ranked.select(
        "raceId", "season", "round",
        F.concat(F.lit("c"), ((F.col("round") - 1) % VENUES).cast("string")).alias("circuitId"),
        F.concat(F.lit("s"), F.col("suppkey").cast("string")).alias("driverId"),
        F.concat(F.lit("n"), (F.col("s_nationkey") % TEAMS).cast("string")).alias("constructorId"),
        F.col("_grid").cast("double").alias("grid"),
        F.col("_pos").cast("double").alias("positionOrder"),
        _status().alias("status"),
    ).withColumn("points", points_of("positionOrder"))

    qualifying = ranked.filter("_timed").select(
        "raceId",
        F.concat(F.lit("s"), F.col("suppkey").cast("string")).alias("driverId"),
        F.col("_qpos").cast("double").alias("qualifying_pos"),
        F.col("q_slow").cast("double").alias("q1_ms"),
        F.lit(None).cast("double").alias("q2_ms"),
        F.col("q_best").cast("double").alias("q3_ms"),
    ).withColumn("driver_best_q_ms", F.least("q1_ms", "q2_ms", "q3_ms"))

    sprints = ranked.filter("_sprint").select(
        "raceId",
        F.concat(F.lit("s"), F.col("suppkey").cast("string")).alias("driverId"),
        F.col("_spos").cast("double").alias("sprint_finish"),
    ).withColumn("sprint_points", points_of("sprint_finish"))
    return results, qualifying, sprints


# ---------------------------------------------------------------------------
# SQL text of the same derivation (DuckDB dialect), used by the oracle.

def sql_points_case(expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(POINTS_BY_POSITION, start=1))
    return f"(CASE CAST(FLOOR({expr}) AS BIGINT) {whens} ELSE 0.0 END)"


ADAPTER_SQL_CTES = f"""
li_agg AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS season,
         CAST(month(l_shipdate) AS BIGINT) AS round,
         l_suppkey AS suppkey,
         COUNT(*) AS n,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
         SUM(l_linenumber) AS sumline,
         SUM(l_quantity) AS sumqty,
         MIN(CAST(round(l_extendedprice * 100) AS BIGINT)) AS q_best,
         MAX(CAST(round(l_extendedprice * 100) AS BIGINT)) AS q_slow
  FROM lineitem GROUP BY 1, 2, 3
),
li_base AS (
  SELECT a.*, s.s_nationkey,
         CAST(a.season AS VARCHAR) || '_' || CAST(a.round AS VARCHAR) AS raceId
  FROM li_agg a JOIN supplier s ON a.suppkey = s.s_suppkey
),
fact_results0 AS (
  SELECT raceId, season, round,
         'c' || CAST((round - 1) % {VENUES} AS VARCHAR) AS circuitId,
         's' || CAST(suppkey AS VARCHAR) AS driverId,
         'n' || CAST(s_nationkey % {TEAMS} AS VARCHAR) AS constructorId,
         CAST(row_number() OVER (PARTITION BY raceId ORDER BY sumline DESC, suppkey) AS DOUBLE) AS grid,
         CAST(row_number() OVER (PARTITION BY raceId ORDER BY sumqty DESC, suppkey) AS DOUBLE) AS positionOrder,
         CASE WHEN r = n AND n = 1 THEN 'Did not start'
              WHEN 2 * r > n THEN 'Retired'
              WHEN r > 0 THEN '+1 Lap'
              ELSE 'Finished' END AS status
  FROM li_base
),
fact_results AS (
  SELECT *, {sql_points_case('positionOrder')} AS points FROM fact_results0
),
fact_qualifying AS (
  SELECT raceId, 's' || CAST(suppkey AS VARCHAR) AS driverId,
         CAST(row_number() OVER (PARTITION BY raceId ORDER BY q_best, suppkey) AS DOUBLE) AS qualifying_pos,
         CAST(q_slow AS DOUBLE) AS q1_ms,
         CAST(NULL AS DOUBLE) AS q2_ms,
         CAST(q_best AS DOUBLE) AS q3_ms,
         CAST(least(q_slow, q_best) AS DOUBLE) AS driver_best_q_ms
  FROM li_base WHERE NOT (suppkey % 7 = 0 AND round % 5 = 0)
),
fact_sprints_r AS (
  SELECT raceId, 's' || CAST(suppkey AS VARCHAR) AS driverId,
         CAST(row_number() OVER (PARTITION BY raceId ORDER BY n DESC, suppkey) AS DOUBLE) AS sprint_finish
  FROM li_base WHERE round IN {SPRINT_MONTHS}
),
fact_sprints AS (
  SELECT *, {sql_points_case('sprint_finish')} AS sprint_points FROM fact_sprints_r
)"""


# ---------------------------------------------------------------------------
# Time and number strings derived from the line items, for the string
# parsers (lap times, numeric coercion, null tokens).

def lap_string(ms, short: bool = False) -> F.Column:
    """``m:ss.fff`` (or ``s.fff`` when short) for a millisecond count."""
    frac = F.lpad((ms % 1000).cast("string"), 3, "0")
    if short:
        return F.concat(F.floor(ms / 1000).cast("bigint").cast("string"), F.lit("."), frac)
    return F.concat(F.floor(ms / 60000).cast("bigint").cast("string"), F.lit(":"),
                    F.lpad(F.floor((ms % 60000) / 1000).cast("bigint").cast("string"), 2, "0"),
                    F.lit("."), frac)


def noisy_number_string(qty, line) -> F.Column:
    """A numeric-looking string whose shape depends on the line number:
    plain, null token, typed suffix, padded, empty, three-part, letter."""
    q = qty.cast("bigint").cast("string")
    return (F.when(line == 1, q)
            .when(line == 2, F.lit("\\N"))
            .when(line == 3, F.concat(q, F.lit("D")))
            .when(line == 4, F.concat(F.lit(" "), q, F.lit(" ")))
            .when(line == 5, F.lit(""))
            .when(line == 6, F.concat(q, F.lit(":"), line.cast("string"), F.lit(":1")))
            .otherwise(F.concat(F.lit("R"), q)))


def derived_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(table_path(sf_dir, "lineitem"))
    return li.select(
        "l_orderkey", "l_linenumber",
        lap_string(F.round(F.col("l_extendedprice") * 10).cast("bigint")).alias("lap"),
        lap_string(F.round(F.col("l_extendedprice") * 7).cast("bigint"), short=True).alias("lap_short"),
        noisy_number_string(F.col("l_quantity"), F.col("l_linenumber")).alias("numtxt"))


STRINGS_SQL_CTE = """
strs AS (
  SELECT l_orderkey, l_linenumber,
    CAST(floor(CAST(round(l_extendedprice * 10) AS BIGINT) / 60000) AS BIGINT)::VARCHAR || ':'
      || lpad(CAST(floor((CAST(round(l_extendedprice * 10) AS BIGINT) % 60000) / 1000) AS BIGINT)::VARCHAR, 2, '0')
      || '.' || lpad((CAST(round(l_extendedprice * 10) AS BIGINT) % 1000)::VARCHAR, 3, '0') AS lap,
    CAST(floor(CAST(round(l_extendedprice * 7) AS BIGINT) / 1000) AS BIGINT)::VARCHAR || '.'
      || lpad((CAST(round(l_extendedprice * 7) AS BIGINT) % 1000)::VARCHAR, 3, '0') AS lap_short,
    CASE l_linenumber
      WHEN 1 THEN CAST(l_quantity AS BIGINT)::VARCHAR
      WHEN 2 THEN '\\N'
      WHEN 3 THEN CAST(l_quantity AS BIGINT)::VARCHAR || 'D'
      WHEN 4 THEN ' ' || CAST(l_quantity AS BIGINT)::VARCHAR || ' '
      WHEN 5 THEN ''
      WHEN 6 THEN CAST(l_quantity AS BIGINT)::VARCHAR || ':' || l_linenumber::VARCHAR || ':1'
      ELSE 'R' || CAST(l_quantity AS BIGINT)::VARCHAR END AS numtxt
  FROM lineitem
)"""
