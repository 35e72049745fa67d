"""Feature matrix (P23) from the three fact tables.

Builders are ordered by partition key — event block, entity history, team
history, venue block, reliability — so windows over the same keys share one
exchange. The joined entries, and the range tables of the skew-safe ranks,
are written once in the shared checkpoint folder; the rest is one lazy plan.
The result is checked against a schema contract before it is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import classified_flag, era_of, map_by_period_rules
from ..operators import event as ev
from ..operators import form as fm
from ..operators import reliability as rl
from ..operators import venue as vn
from ..spec import FEATURES, PanelSpec, Params

DEFAULT_SPEC = PanelSpec()

# Fixed names: the matrix contract.
MATRIX_COLUMNS = (
    "raceId", "season", "round", "circuitId", "driverId", "constructorId",
    "pu_manufacturer", "qualifying_pos", "grid_penalty_delta", "pace_delta_pct",
    "teammate_delta_pct", "teammate_h2h_form", "sprint_finish", "driver_pts_lag",
    "team_pts_lag", "driver_form_ewma", "constructor_form_ewma",
    "track_retention_idx", "track_retention_confidence", "driver_dnf_rate_10",
    "constructor_dnf_rate_10", "driver_team_dnf_rate_10", "pu_dnf_rate_10",
    "circuit_dnf_rate_5yr", "regulatory_era", "status", "is_classified",
    "positionOrder",
)

_STRING = {"raceId", "circuitId", "driverId", "constructorId", "pu_manufacturer",
           "regulatory_era", "status"}
_LONG = {"season", "round", "is_classified"}

MATRIX_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in _STRING else T.LongType() if c in _LONG else T.DoubleType())
    for c in MATRIX_COLUMNS
])

EXTENDED_COLUMNS = ("grid", "is_sprint_weekend", "team_point_contribution_pct",
                    "pace_x_overtaking", "grid_x_retention")


def require_columns(df: DataFrame, cols) -> None:
    """Fail early when an input lacks columns (S9; catches Q2/Q15-style drift)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_contract(df: DataFrame, schema: T.StructType = MATRIX_SCHEMA) -> DataFrame:
    """Exact names, order and types of the matrix (nullability not enforced)."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in schema.fields]
    if got != want:
        raise ValueError(f"matrix contract violated:\n got  {got}\n want {want}")
    return df


def prepare_entries(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                    params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """P5 period floor, P10 non-starters out, J1/J2 joins, P11 start features."""
    require_columns(results, [spec.event, spec.period, spec.seq, spec.venue, spec.entity,
                              spec.team, spec.start, spec.outcome, spec.reward, spec.status])
    res = results.filter(F.col(spec.period) >= F.lit(params.first_period))
    res = ev.drop_non_starters(res, spec)
    df = ev.attach_facts(res, qualifying, sprints, spec)
    return ev.start_features(df, spec)


def label_columns(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Era (P17), classified flag and failure flag (P18), supplier."""
    return df.withColumn("regulatory_era", era_of(spec.period, params.eras, params.era_default)) \
             .withColumn("is_classified", classified_flag(spec.status)) \
             .withColumn("is_dnf", F.lit(1) - F.col("is_classified")) \
             .withColumn(spec.supplier, map_by_period_rules(spec.team, spec.period,
                                                             params.supplier_rules,
                                                             params.supplier_default))


def entries_table(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                  params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                  materialize: bool = True) -> DataFrame:
    """Joined, filtered, labelled entries: the input of every feature block.

    With ``materialize`` the table is written as parquet into a fresh folder
    under the shared checkpoint folder (``spark.checkpoint.dir``) and read
    back: it feeds a dozen branches, so the upstream scan runs once, the
    lineage is cut (a lost executor re-reads files, it does not recompute),
    and each branch gets column pruning and real size statistics for its
    join strategy.
    """
    base = label_columns(prepare_entries(results, qualifying, sprints, params, spec), params, spec)
    if materialize:
        from ..session import materialize as write_and_read
        base = write_and_read(base, "entries")
    return base


def feature_table(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                  params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                  materialize: bool = True) -> DataFrame:
    """All intermediate and final feature columns (before projection)."""
    return features_of(entries_table(results, qualifying, sprints, params, spec, materialize), params, spec)


def features_of(base: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """The feature columns of an entries table (``entries_table``).

    The venue tables branch off the entries table (few columns, short
    lineage) and come back by a join on (venue, period). Per-event, per-team,
    per-period and per-venue tables are written before they are joined: their
    sizes are known, so small ones are broadcast and the rows are shuffled
    twice only, by entity for the windows over histories (whose order shares
    sorts) and by (event, entity) for the rates of teams and suppliers.
    """
    from ..session import materialize as write_and_read
    # venue block: small tables keyed by (venue, period)
    ret = write_and_read(vn.venue_retention(base, params, spec), "venue-retention")
    vrate = write_and_read(rl.venue_event_rate(base, params, spec), "venue-rates")
    # side tables from the entries table
    totals = write_and_read(fm.team_event_totals(fm.weekend_reward(base, spec), spec), "team-totals")
    # event block
    df = ev.pace_features(base, params, spec, source=base)
    # entity / team history; the first three windows need one sort
    df = rl.entity_rate(df, params, spec)
    df = fm.weekend_reward(df, spec)
    df = fm.driver_points_lag(df, spec)
    df = fm.decayed_form(df, totals, params, spec, source=base, more={"h2h_win": "teammate_h2h_form"})
    df = fm.h2h_fill(df, params)
    df = fm.team_points_lag(df, totals, spec)
    # reliability
    df = rl.entity_team_rate(df, params, spec)
    df = rl.key_rates(df, base, params, spec)
    df = df.join(ret, [spec.venue, spec.period], "left") \
        .withColumn("track_retention_idx", F.coalesce("track_retention_idx", F.lit(params.retention_fill))) \
        .withColumn("track_retention_confidence", F.coalesce("track_retention_confidence", F.lit(0.0)))
    df = df.join(vrate, [spec.venue, spec.period], "left") \
        .withColumn("circuit_dnf_rate_5yr", F.coalesce("circuit_dnf_rate_5yr", F.lit(params.dnf_rate_fill)))
    return df


def _project(df: DataFrame) -> DataFrame:
    cols = []
    for f in MATRIX_SCHEMA.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def feature_matrix(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                   params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                   materialize: bool = True) -> DataFrame:
    """The 28-column matrix, contract-checked."""
    return check_contract(_project(feature_table(results, qualifying, sprints, params, spec, materialize)))


def extended_matrix(results: DataFrame, qualifying: DataFrame, sprints: DataFrame,
                    params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                    materialize: bool = True) -> DataFrame:
    """Matrix plus the extra columns some strategies consume.

    The features are written once, and the sprint flags of the events, few rows, are
    written too: the tables joined here would else compute every feature each.
    Without ``materialize`` the plan stays lazy."""
    from ..session import materialize as write_and_read
    full = feature_table(results, qualifying, sprints, params, spec, materialize)
    if materialize:
        full = write_and_read(full.select(*dict.fromkeys([*MATRIX_COLUMNS, spec.start])), "features")
    base = _project(full)
    sprint_ev = full.groupBy(spec.event).agg(
        F.max(F.col("sprint_finish").isNotNull().cast("bigint")).alias("is_sprint_weekend"))
    if materialize:
        sprint_ev = write_and_read(sprint_ev, "sprint-events")
    ext = full.select(
        spec.event, spec.entity,
        F.col(spec.start).cast("double").alias("grid"),
        F.try_divide(F.col("driver_pts_lag"), F.col("team_pts_lag")).alias("team_point_contribution_pct"),
        (F.col("pace_delta_pct") * (F.lit(1.0) - F.col("track_retention_idx"))).alias("pace_x_overtaking"),
        (F.col(spec.start) * F.col("track_retention_idx")).alias("grid_x_retention"),
    ).join(sprint_ev, spec.event, "left")
    return base.join(ext, [spec.event, spec.entity], "left")


__all__ = ["feature_matrix", "feature_table", "extended_matrix", "check_contract",
           "require_columns", "MATRIX_SCHEMA", "MATRIX_COLUMNS", "FEATURES"]
