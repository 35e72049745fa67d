"""Raw nested JSON pages -> fact tables.

A page is one JSON object with the envelope
``MRData{total, RaceTable.Races[], DriverTable.Drivers[], ConstructorTable...}``;
all members are strings. A file holds one page (multi-line, named
``<prefix>_offset_<n>.json``) or many (``lines``: one object per line with the
page's name in ``page``). Pages are read with an explicit schema (no
inference pass), exploded with ``posexplode`` (array positions kept for a
deterministic keep-first), and de-duplicated on (event, entity) by the
smallest (file, race index, row index).

A malformed page never disappears: its text is kept in ``_corrupt_record``,
the parsers raise on it (or, with ``on_bad="quarantine"``, leave it to
``bad_pages``), and the landing audit does not count it as landed. Rows
without an entity id match nothing later; the parsers leave them to
``keyless_rows``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import best_of, event_key, lap_time_ms, normalize_null, to_int, to_number
from ..spec import Params

S = T.StringType()


def _arr(*fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


_DRIVER = T.StructType([T.StructField("driverId", S)])
_CONSTRUCTOR = T.StructType([T.StructField("constructorId", S)])

RACE_SCHEMA = T.StructType([
    T.StructField("season", S), T.StructField("round", S),
    T.StructField("Circuit", T.StructType([T.StructField("circuitId", S)])),
    T.StructField("Results", _arr(("Driver", _DRIVER), ("Constructor", _CONSTRUCTOR), ("grid", S),
                                  ("position", S), ("points", S), ("status", S))),
    T.StructField("QualifyingResults", _arr(("Driver", _DRIVER), ("position", S), ("Q1", S), ("Q2", S),
                                            ("Q3", S))),
    T.StructField("SprintResults", _arr(("Driver", _DRIVER), ("position", S), ("points", S))),
])

CORRUPT = "_corrupt_record"
RAW_SCHEMA = T.StructType([T.StructField("MRData", T.StructType([
    T.StructField("total", S),
    T.StructField("DriverTable", T.StructType([T.StructField("Drivers", _arr(("driverId", S)))])),
    T.StructField("ConstructorTable", T.StructType([
        T.StructField("Constructors", _arr(("constructorId", S)))])),
    T.StructField("RaceTable", T.StructType([T.StructField("Races", T.ArrayType(RACE_SCHEMA))])),
])), T.StructField("page", S), T.StructField(CORRUPT, S)])

PAGE_RE = r"([^/=]+?)_offset_([0-9]+)(\.json)?$"


def read_raw(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Read pages (S1). ``paths`` may be globs, e.g. ``dir/*results*.json``, or
    folders of page files (``lines``).

    Adds ``_file`` (page name without folder) for ordering and audits.
    """
    return with_page_name(json_options(spark.read, lines).json(paths))


def json_options(reader, lines: bool = False):
    """The options of every page reader, batch or stream."""
    return reader.schema(RAW_SCHEMA).option("multiLine", not lines).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT)


def with_page_name(df: DataFrame) -> DataFrame:
    # the name inside the page file, else that of the file
    name = F.coalesce("page", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    return df.select("MRData", CORRUPT, name.alias("_file"))


KINDS = ("results", "qualifying", "sprint", "active_drivers", "active_constructors")


def landing_paths(root: str, *kinds: str) -> list[str]:
    """Folders of the page files of some kinds under a landing folder."""
    return [f"{root.rstrip('/')}/{kind}" for kind in kinds]


def _is_bad():
    return F.col(CORRUPT).isNotNull() | F.col("MRData").isNull()


def bad_pages(raw: DataFrame) -> DataFrame:
    """Malformed pages with their text: the quarantine table."""
    return raw.filter(_is_bad()).select("_file", F.col(CORRUPT).alias("text"))


def good_pages(raw: DataFrame, on_bad: str = "raise") -> DataFrame:
    """Pages that parsed. ``raise`` fails the query on a malformed page and
    names it; ``quarantine`` leaves such pages to ``bad_pages``."""
    if on_bad == "quarantine":
        return raw.filter(~_is_bad())
    if on_bad != "raise":
        raise ValueError(f"on_bad: {on_bad}")
    message = F.concat(F.lit("malformed page "), F.col("_file"))
    return raw.withColumn("MRData", F.when(_is_bad(), F.raise_error(message)).otherwise(F.col("MRData")))


def _races(raw: DataFrame, params: Params, on_bad: str) -> DataFrame:
    r = good_pages(raw, on_bad).select("_file", F.posexplode("MRData.RaceTable.Races").alias("_race_idx", "race"))
    season, rnd = to_int("race.season", 0), to_int("race.round", 0)
    r = r.select("_file", "_race_idx", "race", season.alias("season"), rnd.alias("round"))
    return r.filter(F.col("season") >= F.lit(params.first_period)) \
            .withColumn("raceId", event_key("season", "round"))


POSITION = ("_file", "_race_idx", "_row_idx")


def keep_first(df: DataFrame, keys: list[str] | None = None, positions: bool = False) -> DataFrame:
    """One row per (raceId, driverId): the first by (file, race, row) (U3, Q12). With ``positions`` the
    result keeps these, so that it can be merged with more pages and reduced again."""
    keys = keys or ["raceId", "driverId"]
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*POSITION)
    first = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return first if positions else first.drop(*POSITION)


def keyless_rows(exploded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that the keep-first leaves out because a key is null."""
    missing = F.lit(False)
    for k in keys or ["raceId", "driverId"]:
        missing = missing | F.col(k).isNull()
    return exploded.filter(missing)


def _result_columns(rows: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    nn = normalize_null
    return rows.select(
        *keep, "_file", "_race_idx", "_row_idx", "raceId", "season", "round",
        nn(F.col("race.Circuit.circuitId")).alias("circuitId"),
        nn(F.col("res.Driver.driverId")).alias("driverId"),
        nn(F.col("res.Constructor.constructorId")).alias("constructorId"),
        to_number(nn(F.col("res.grid"))).alias("grid"),
        to_number(nn(F.col("res.position"))).alias("positionOrder"),
        to_number(nn(F.col("res.points"))).alias("points"),
        nn(F.col("res.status")).alias("status"))


QUARANTINE_KINDS = ("facts", "keyless_rows", "bad_pages")


def explode_results(raw: DataFrame, params: Params = Params(), on_bad: str = "raise") -> DataFrame:
    """Results pages -> flat rows with their page position, before the
    keep-first (streaming-safe: no window)."""
    r = _races(raw, params, on_bad).select("*", F.posexplode("race.Results").alias("_row_idx", "res"))
    return _result_columns(r)


def quarantine_results(raw: DataFrame, path: str, params: Params = Params()) -> dict[str, int]:
    """One pass over results pages into a table with a folder per kind of row: ``facts`` (flat rows with their
    page position), ``keyless_rows`` (no event or entity) and ``bad_pages`` (malformed, with their text). Returns
    the number of rows of each, counted while they are written."""
    bad = _is_bad()
    pages = raw.select("_file", F.col(CORRUPT).alias("text"), bad.alias("_bad"), F.posexplode_outer(
        F.when(~bad, F.col("MRData.RaceTable.Races"))).alias("_race_idx", "race"))
    rows = pages.select("*", F.posexplode_outer("race.Results").alias("_row_idx", "res")).filter(
        "_bad OR res IS NOT NULL")
    season, rnd = to_int("race.season", 0), to_int("race.round", 0)
    flat = _result_columns(rows.withColumn("season", season).withColumn("round", rnd).withColumn(
        "raceId", event_key("season", "round")), ["_bad", "text"])
    flat = flat.filter(F.col("_bad") | (F.col("season") >= F.lit(params.first_period)))
    keyless = F.col("raceId").isNull() | F.col("driverId").isNull()
    kind = F.when(F.col("_bad"), "bad_pages").when(keyless, "keyless_rows").otherwise("facts")
    flat = flat.withColumn("kind", kind).withColumn("text", F.when(F.col("_bad"), F.col("text"))).drop("_bad")
    seen = Observation("quarantine")
    flat = flat.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in QUARANTINE_KINDS])
    flat.write.mode("overwrite").partitionBy("kind").parquet(path)
    return {k: int(seen.get[k] or 0) for k in QUARANTINE_KINDS}


def read_quarantined(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one kind; of facts the first of each (raceId, driverId)."""
    rows = spark.read.parquet(path).filter(F.col("kind") == kind).drop("kind")
    return keep_first(rows.drop("text")) if kind == "facts" else rows


def parse_results(raw: DataFrame, params: Params = Params(), on_bad: str = "raise") -> DataFrame:
    """Results pages -> fact_results."""
    return keep_first(explode_results(raw, params, on_bad))


def parse_qualifying(raw: DataFrame, params: Params = Params(), on_bad: str = "raise") -> DataFrame:
    """Qualifying pages -> fact_qualifying."""
    r = _races(raw, params, on_bad).select("*", F.posexplode("race.QualifyingResults").alias("_row_idx", "q"))
    out = r.select(
        "_file", "_race_idx", "_row_idx", "raceId",
        F.col("q.Driver.driverId").alias("driverId"),
        to_number("q.position").alias("qualifying_pos"),
        lap_time_ms("q.Q1").alias("q1_ms"), lap_time_ms("q.Q2").alias("q2_ms"),
        lap_time_ms("q.Q3").alias("q3_ms"))
    return keep_first(out.withColumn("driver_best_q_ms", best_of("q1_ms", "q2_ms", "q3_ms")))


def parse_sprints(raw: DataFrame, params: Params = Params(), on_bad: str = "raise") -> DataFrame:
    """Sprint pages -> fact_sprints."""
    r = _races(raw, params, on_bad).select("*", F.posexplode("race.SprintResults").alias("_row_idx", "s"))
    out = r.select(
        "_file", "_race_idx", "_row_idx", "raceId",
        F.col("s.Driver.driverId").alias("driverId"),
        to_number("s.position").alias("sprint_finish"),
        to_number("s.points").alias("sprint_points"))
    return keep_first(out)


# ---------------------------------------------------------------------------
# landing contract

def page_index(raw: DataFrame) -> DataFrame:
    """(prefix, offset, total, landed) for every page file; a malformed page is not landed."""
    m = F.regexp_extract("_file", PAGE_RE, 1)
    o = F.regexp_extract("_file", PAGE_RE, 2)
    return raw.select(m.alias("prefix"), o.cast("bigint").alias("offset"),
                      to_int("MRData.total", 0).alias("total"), (~_is_bad()).alias("landed"))


def missing_pages(raw: DataFrame, page_size: int = 100) -> DataFrame:
    """Pages an endpoint should have (offsets 0, size, ... below total, and
    every page file there is) but that are not landed (S2). A total of 0
    expects no page beyond offset 0."""
    idx = page_index(raw)
    expected = idx.groupBy("prefix").agg(F.max(F.when(F.col("landed"), F.col("total"))).alias("total")) \
        .select("prefix", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                               F.greatest(F.coalesce("total", F.lit(0)) - 1, F.lit(0)).cast("bigint"),
                                               F.lit(page_size).cast("bigint"))).alias("offset"))
    expected = expected.unionByName(idx.filter("NOT landed").select("prefix", "offset")).distinct()
    return expected.join(idx.filter("landed").select("prefix", "offset"), ["prefix", "offset"], "left_anti")


def pending_requests(events: DataFrame, landed: DataFrame,
                     endpoints=("results", "qualifying", "sprint")) -> DataFrame:
    """(season, round, endpoint) still to fetch: every event x endpoint
    without a landed page (S3). ``events`` has season, round."""
    eps = F.array(*[F.lit(e) for e in endpoints])
    want = events.select("season", "round").distinct().select("season", "round", F.explode(eps).alias("endpoint"))
    got = page_index(landed).filter("landed").select(
        F.regexp_extract("prefix", r"^race_([0-9]+)_([0-9]+)_(.+)$", 1).cast("bigint").alias("season"),
        F.regexp_extract("prefix", r"^race_([0-9]+)_([0-9]+)_(.+)$", 2).cast("bigint").alias("round"),
        F.regexp_extract("prefix", r"^race_([0-9]+)_([0-9]+)_(.+)$", 3).alias("endpoint")).distinct()
    return want.join(got, ["season", "round", "endpoint"], "left_anti")


def active_entities(raw: DataFrame, kind: str = "driver") -> DataFrame:
    """Distinct ids from listing pages (S4); a malformed page is an error."""
    raw = good_pages(raw)
    if kind == "driver":
        return raw.select(F.explode("MRData.DriverTable.Drivers.driverId").alias("id")).distinct()
    return raw.select(F.explode("MRData.ConstructorTable.Constructors.constructorId").alias("id")).distinct()


def event_universe(race_pages: DataFrame, active: DataFrame, start_period: int) -> DataFrame:
    """Distinct (season, round) from period ``start_period`` on in which an
    active entity took part (S5): explode, filter, semi-join, distinct."""
    r = good_pages(race_pages).select(F.explode("MRData.RaceTable.Races").alias("race"))
    r = r.select(to_int("race.season", 0).alias("season"), to_int("race.round", 0).alias("round"),
                 F.explode("race.Results.Driver.driverId").alias("id"))
    r = r.filter(F.col("season") >= F.lit(start_period))
    return r.join(active, "id", "left_semi").select("season", "round").distinct()


def race_list_universe(race_lists: DataFrame, active: DataFrame, start_period: int) -> DataFrame:
    """Distinct (season, round) from period ``start_period`` on in the race lists of active entities (S5). A
    page ``driver_<id>_races_offset_<n>`` lists events of one entity; lists share events and pages may overlap. The
    lists of other entities are left before their events are exploded."""
    entity = F.regexp_extract("_file", r"^driver_(.+)_races(?:_[a-z]+)?_offset_[0-9]+(?:\.json)?$", 1)
    r = good_pages(race_lists).withColumn("id", entity).join(active, "id", "left_semi")
    r = r.select(F.explode("MRData.RaceTable.Races").alias("race")).select(
        to_int("race.season", 0).alias("season"), to_int("race.round", 0).alias("round"))
    return r.filter(F.col("season") >= F.lit(start_period)).distinct()


# ---------------------------------------------------------------------------
# the parameter artifact

PARAM_FIELDS = ("off_season_decay", "regulation_reset_decay", "summer_break_decay",
                "driver_reg_reset_decay", "summer_break_round")


def save_params(spark: SparkSession, params: Params, path: str) -> None:
    row = [(params.off_season_decay, params.regulation_reset_decay, params.summer_break_decay,
            params.driver_reg_reset_decay, params.summer_seq)]
    spark.createDataFrame(row, "off_season_decay double, regulation_reset_decay double, "
                               "summer_break_decay double, driver_reg_reset_decay double, "
                               "summer_break_round bigint").coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str, defaults: Params = Params()) -> Params:
    """Read the one-row parameter table; missing file, column or value falls
    back to the defaults (S8). The single row is the artifact, not data."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return defaults
    cols = []
    for f in PARAM_FIELDS:
        cols.append(F.col(f).cast("double").alias(f) if f in df.columns else F.lit(None).cast("double").alias(f))
    rows = df.select(*cols).limit(1).collect()
    if not rows:
        return defaults
    r = rows[0]

    def pick(name, attr, cast=float):
        v = r[name]
        return cast(v) if v is not None else getattr(defaults, attr)

    return defaults.with_(
        off_season_decay=pick("off_season_decay", "off_season_decay"),
        regulation_reset_decay=pick("regulation_reset_decay", "regulation_reset_decay"),
        summer_break_decay=pick("summer_break_decay", "summer_break_decay"),
        driver_reg_reset_decay=pick("driver_reg_reset_decay", "driver_reg_reset_decay"),
        summer_seq=pick("summer_break_round", "summer_seq", int))
