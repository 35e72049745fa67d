"""DuckDB oracle SQL for the registered queries.

Each query is written independently of the Spark code, in plain SQL over
the driver's tables: the panel adapter CTEs, then the feature semantics in
their most direct (often quadratic) form — self-joins for team-mates and
exponential weights, correlated ranges for past periods. Only lookup tables
(points, eras, supplier rules) are generated from the same constants.
"""

from __future__ import annotations

from paddock.sources.adapter import ADAPTER_SQL_CTES, STRINGS_SQL_CTE
from paddock.sources.landing import SOILED_SQL
from paddock.functions.scalars import NUMERIC_PATTERN
from paddock.spec import ADAPTER_SWEEP_GRID as SWEEP_GRID
from paddock.spec import RELEVANCE_BY_POSITION, RELEVANCE_DEFAULT, adapter_params

P = adapter_params()
BETA = 1.0 - P.ewma_alpha
RESETS = "(" + ", ".join(str(s) for s in P.reset_periods) + ")"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def era_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in P.eras)
    return f"(CASE {whens} ELSE '{P.era_default}' END)"


def supplier_case(team: str, period: str) -> str:
    parts = []
    for ids, ranges, label in P.supplier_rules:
        idlist = ", ".join(f"'{i}'" for i in ids)
        rconds = []
        for lo, hi in ranges:
            c = ["TRUE"]
            if lo is not None:
                c.append(f"{period} >= {lo}")
            if hi is not None:
                c.append(f"{period} <= {hi}")
            rconds.append("(" + " AND ".join(c) + ")")
        parts.append(f"WHEN lower({team}) IN ({idlist}) AND ({' OR '.join(rconds)}) THEN '{label}'")
    return f"(CASE WHEN {team} IS NULL THEN '{P.supplier_default}' {' '.join(parts)} ELSE '{P.supplier_default}' END)"


def relevance_case(col: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(RELEVANCE_BY_POSITION, start=1))
    return f"(CASE CAST(trunc({col}) AS BIGINT) {whens} ELSE {RELEVANCE_DEFAULT} END)"


def points_case(col: str) -> str:
    from paddock.spec import POINTS_BY_POSITION
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(POINTS_BY_POSITION, start=1))
    return f"(CASE CAST(trunc(coalesce({col}, 0)) AS BIGINT) {whens} ELSE 0.0 END)"


# ---------------------------------------------------------------------------
# feature CTE chain (names are stable so queries can pick intermediate steps)
FEATURE_CTES = ADAPTER_SQL_CTES + f""",
res AS (
  SELECT * FROM fact_results
  WHERE season >= {P.first_period}
    AND NOT coalesce(regexp_matches(status, '(?i)(dns|did not start)'), false)
),
e0 AS (
  SELECT r.*, q.qualifying_pos AS q_pos, q.driver_best_q_ms, s.sprint_finish, s.sprint_points AS sp_raw
  FROM res r
  LEFT JOIN fact_qualifying q ON r.raceId = q.raceId AND r.driverId = q.driverId
  LEFT JOIN fact_sprints s ON r.raceId = s.raceId AND r.driverId = s.driverId
),
e1 AS (
  SELECT *,
    coalesce(q_pos, grid) AS qualifying_pos,
    grid - coalesce(q_pos, grid) AS grid_penalty_delta,
    (driver_best_q_ms - min(driver_best_q_ms) OVER (PARTITION BY raceId))
      / nullif(min(driver_best_q_ms) OVER (PARTITION BY raceId), 0) * 100 AS pace_raw,
    CAST(CASE WHEN status = 'Finished' OR contains(status, 'Lap') THEN 1 ELSE 0 END AS BIGINT) AS is_classified,
    {era_case('season')} AS regulatory_era,
    {supplier_case('constructorId', 'season')} AS pu_manufacturer
  FROM e0
),
mates AS (
  SELECT a.raceId, a.driverId,
    first(b.driver_best_q_ms ORDER BY b.positionOrder NULLS LAST, b.driverId)
      FILTER (WHERE b.driver_best_q_ms IS NOT NULL) AS t_tm,
    first(b.pace_raw ORDER BY b.positionOrder NULLS LAST, b.driverId)
      FILTER (WHERE b.pace_raw IS NOT NULL) AS pace_tm,
    first(b.positionOrder ORDER BY b.positionOrder NULLS LAST, b.driverId)
      FILTER (WHERE b.positionOrder IS NOT NULL) AS pos_tm
  FROM e1 a JOIN e1 b ON a.raceId = b.raceId AND a.constructorId = b.constructorId AND a.driverId <> b.driverId
  GROUP BY a.raceId, a.driverId
),
e2 AS (
  SELECT e1.*, m.t_tm, m.pace_tm, m.pos_tm,
    coalesce(pace_raw, m.pace_tm + {P.pace_margin}, max(pace_raw) OVER (PARTITION BY e1.raceId) + {P.pace_margin},
             {P.pace_fill}) AS pace_delta_pct,
    CASE WHEN driver_best_q_ms IS NULL AND m.t_tm IS NOT NULL THEN {P.teammate_delta_fill}
         WHEN driver_best_q_ms IS NOT NULL AND m.t_tm IS NULL THEN -{P.teammate_delta_fill}
         ELSE coalesce((driver_best_q_ms - m.t_tm) / nullif(m.t_tm, 0) * 100, 0.0) END AS teammate_delta_pct,
    CASE WHEN positionOrder > {P.h2h_cutoff} AND m.pos_tm > {P.h2h_cutoff} THEN 0.5
         ELSE CAST(coalesce(positionOrder < m.pos_tm, false) AS DOUBLE) END AS h2h_win,
    coalesce(sp_raw, 0.0) AS sprint_points,
    points + coalesce(sp_raw, 0.0) AS total_weekend_pts,
    row_number() OVER (PARTITION BY e1.driverId ORDER BY season, round) AS d_idx
  FROM e1 LEFT JOIN mates m ON e1.raceId = m.raceId AND e1.driverId = m.driverId
),
h2h AS (
  SELECT a.raceId, a.driverId,
    sum(power({BETA}, a.d_idx - 1 - b.d_idx) * b.h2h_win) / sum(power({BETA}, a.d_idx - 1 - b.d_idx)) AS v
  FROM e2 a JOIN e2 b ON a.driverId = b.driverId AND b.d_idx < a.d_idx AND b.h2h_win IS NOT NULL
  GROUP BY a.raceId, a.driverId
),
dform AS (
  SELECT a.raceId, a.driverId,
    sum(power({BETA}, a.d_idx - 1 - b.d_idx) * b.positionOrder) / sum(power({BETA}, a.d_idx - 1 - b.d_idx)) AS v
  FROM e2 a JOIN e2 b ON a.driverId = b.driverId AND b.d_idx < a.d_idx AND b.positionOrder IS NOT NULL
  GROUP BY a.raceId, a.driverId
),
team_tot AS (
  SELECT season, round, constructorId, coalesce(sum(total_weekend_pts), 0.0) AS team_total,
         row_number() OVER (PARTITION BY constructorId ORDER BY season, round) AS t_idx
  FROM e2 GROUP BY season, round, constructorId
),
team_lag AS (
  SELECT season, round, constructorId, team_total,
    coalesce(sum(team_total) OVER (PARTITION BY season, constructorId ORDER BY round
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS team_pts_lag
  FROM team_tot
),
cform AS (
  SELECT a.season, a.round, a.constructorId,
    sum(power({BETA}, a.t_idx - 1 - b.t_idx) * b.team_total) / sum(power({BETA}, a.t_idx - 1 - b.t_idx)) AS v
  FROM team_tot a JOIN team_tot b ON a.constructorId = b.constructorId AND b.t_idx < a.t_idx
  GROUP BY a.season, a.round, a.constructorId
),
first_seq AS (SELECT season, min(round) AS first_round FROM e2 GROUP BY season),
med AS (SELECT quantile_cont(positionOrder, 0.5) AS m FROM e2),
past AS (
  SELECT t.circuitId, t.season,
    count(p.season) AS n_rows, count(DISTINCT p.season) AS n_periods
  FROM (SELECT DISTINCT circuitId, season FROM e2) t
  LEFT JOIN e2 p ON p.circuitId = t.circuitId AND p.season BETWEEN t.season - {P.retention_window} AND t.season - 1
  GROUP BY t.circuitId, t.season
),
past_pairs AS (
  SELECT t.circuitId, t.season, p.grid, p.positionOrder
  FROM (SELECT DISTINCT circuitId, season FROM e2) t
  JOIN e2 p ON p.circuitId = t.circuitId AND p.season BETWEEN t.season - {P.retention_window} AND t.season - 1
  WHERE p.grid IS NOT NULL AND p.positionOrder IS NOT NULL
),
past_ranked AS (
  SELECT circuitId, season,
    rank() OVER (PARTITION BY circuitId, season ORDER BY grid)
      + (count(*) OVER (PARTITION BY circuitId, season, grid) - 1) / 2.0 AS rg,
    rank() OVER (PARTITION BY circuitId, season ORDER BY positionOrder)
      + (count(*) OVER (PARTITION BY circuitId, season, positionOrder) - 1) / 2.0 AS rp
  FROM past_pairs
),
past_rho AS (
  SELECT circuitId, season,
    covar_pop(rg, rp) / nullif(stddev_pop(rg) * stddev_pop(rp), 0) AS rho
  FROM past_ranked GROUP BY circuitId, season
),
ret_base AS (
  SELECT p.*, r.rho FROM past p LEFT JOIN past_rho r ON p.circuitId = r.circuitId AND p.season = r.season
),
ret_global AS (
  SELECT coalesce(avg(rho) FILTER (WHERE n_rows >= {P.retention_global_min_rows} AND rho IS NOT NULL),
                  {P.retention_fill}) AS g FROM ret_base
),
retention AS (
  SELECT circuitId, season,
    least(n_periods / {float(P.retention_window)}, 1.0) AS conf,
    CASE WHEN n_rows >= {P.retention_min_rows} THEN coalesce(rho, g) ELSE g END AS raw, g
  FROM ret_base, ret_global
),
retention_out AS (
  SELECT circuitId, season, conf * raw + (1.0 - conf) * g AS track_retention_idx,
         conf AS track_retention_confidence
  FROM retention
),
e3 AS (
  SELECT e2.*, 1 - e2.is_classified AS is_dnf,
    coalesce(h.v, {P.h2h_fill}) AS teammate_h2h_form,
    coalesce(sum(total_weekend_pts) OVER (PARTITION BY e2.season, e2.driverId ORDER BY e2.round
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS driver_pts_lag,
    tl.team_pts_lag,
    coalesce(df.v, (SELECT m FROM med))
      * (CASE WHEN e2.season IN {RESETS} AND e2.round = fs.first_round THEN {P.driver_reg_reset_decay} ELSE 1.0 END)
      AS driver_form_ewma,
    coalesce(cf.v, 0.0)
      * (CASE WHEN e2.round = fs.first_round THEN {P.off_season_decay} ELSE 1.0 END)
      * (CASE WHEN e2.round = fs.first_round AND e2.season IN {RESETS} THEN {P.regulation_reset_decay} ELSE 1.0 END)
      * (CASE WHEN e2.round = {P.summer_seq} THEN {P.summer_break_decay} ELSE 1.0 END)
      AS constructor_form_ewma,
    coalesce(ro.track_retention_idx, {P.retention_fill}) AS track_retention_idx,
    coalesce(ro.track_retention_confidence, 0.0) AS track_retention_confidence
  FROM e2
  LEFT JOIN h2h h ON e2.raceId = h.raceId AND e2.driverId = h.driverId
  LEFT JOIN dform df ON e2.raceId = df.raceId AND e2.driverId = df.driverId
  LEFT JOIN team_lag tl ON e2.season = tl.season AND e2.round = tl.round AND e2.constructorId = tl.constructorId
  LEFT JOIN cform cf ON e2.season = cf.season AND e2.round = cf.round AND e2.constructorId = cf.constructorId
  LEFT JOIN first_seq fs ON e2.season = fs.season
  LEFT JOIN retention_out ro ON e2.circuitId = ro.circuitId AND e2.season = ro.season
),
venue_rate AS (
  SELECT t.circuitId, t.season,
    CASE WHEN count(p.season) >= {P.venue_rate_min_rows} THEN avg(CAST(p.is_dnf AS DOUBLE))
         ELSE {P.dnf_rate_fill} END AS circuit_dnf_rate_5yr
  FROM (SELECT DISTINCT circuitId, season FROM e3) t
  LEFT JOIN e3 p ON p.circuitId = t.circuitId AND p.season BETWEEN t.season - {P.venue_rate_window} AND t.season - 1
  GROUP BY t.circuitId, t.season
),
e4 AS (
  SELECT e3.*,
    avg(CAST(is_dnf AS DOUBLE)) OVER (PARTITION BY driverId ORDER BY season, round, positionOrder NULLS LAST, driverId
        ROWS BETWEEN {P.reliability_window} PRECEDING AND 1 PRECEDING) AS d_rate,
    avg(CAST(is_dnf AS DOUBLE)) OVER (PARTITION BY constructorId ORDER BY season, round, positionOrder NULLS LAST, driverId
        ROWS BETWEEN {P.reliability_window} PRECEDING AND 1 PRECEDING) AS c_rate,
    avg(CAST(is_dnf AS DOUBLE)) OVER (PARTITION BY driverId, constructorId ORDER BY season, round, positionOrder NULLS LAST, driverId
        ROWS BETWEEN {P.reliability_window} PRECEDING AND 1 PRECEDING) AS dc_rate,
    avg(CAST(is_dnf AS DOUBLE)) OVER (PARTITION BY pu_manufacturer ORDER BY season, round, positionOrder NULLS LAST, driverId
        ROWS BETWEEN {P.reliability_window} PRECEDING AND 1 PRECEDING) AS s_rate
  FROM e3
),
matrix AS (
  SELECT e4.raceId, e4.season, e4.round, e4.circuitId, e4.driverId, e4.constructorId, e4.pu_manufacturer,
    qualifying_pos, grid_penalty_delta, pace_delta_pct, teammate_delta_pct, teammate_h2h_form, sprint_finish,
    driver_pts_lag, team_pts_lag, driver_form_ewma, constructor_form_ewma, track_retention_idx,
    track_retention_confidence,
    coalesce(d_rate, {P.dnf_rate_fill}) AS driver_dnf_rate_10,
    coalesce(c_rate, {P.dnf_rate_fill}) AS constructor_dnf_rate_10,
    coalesce(dc_rate, d_rate, {P.dnf_rate_fill}) AS driver_team_dnf_rate_10,
    coalesce(s_rate, {P.dnf_rate_fill}) AS pu_dnf_rate_10,
    coalesce(v.circuit_dnf_rate_5yr, {P.dnf_rate_fill}) AS circuit_dnf_rate_5yr,
    regulatory_era, status, is_classified, positionOrder
  FROM e4 LEFT JOIN venue_rate v ON e4.circuitId = v.circuitId AND e4.season = v.season
)"""

MATRIX_DOUBLES = (
    "qualifying_pos", "grid_penalty_delta", "pace_delta_pct", "teammate_delta_pct", "teammate_h2h_form",
    "sprint_finish", "driver_pts_lag", "team_pts_lag", "driver_form_ewma", "constructor_form_ewma",
    "track_retention_idx", "track_retention_confidence", "driver_dnf_rate_10", "constructor_dnf_rate_10",
    "driver_team_dnf_rate_10", "pu_dnf_rate_10", "circuit_dnf_rate_5yr", "positionOrder",
)
MATRIX_OTHERS = ("raceId", "season", "round", "circuitId", "driverId", "constructorId", "pu_manufacturer",
                 "regulatory_era", "status", "is_classified")


def with_features(select: str) -> str:
    return f"WITH {FEATURE_CTES}\n{select}"


def matrix_select() -> str:
    cols = list(MATRIX_OTHERS) + [f"{r6(c)} AS {c}" for c in MATRIX_DOUBLES]
    return with_features(f"SELECT {', '.join(cols)} FROM matrix")


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["p23_feature_matrix"] = matrix_select()
    q["p10_drop_non_starters"] = with_features("SELECT raceId, driverId, status FROM res")
    q["j1_j2_attach_facts"] = with_features(
        f"SELECT raceId, driverId, {r6('q_pos')} AS qualifying_pos, {r6('driver_best_q_ms')} AS driver_best_q_ms, "
        f"{r6('sprint_finish')} AS sprint_finish, {r6('sp_raw')} AS sprint_points FROM e0")
    q["p11_start_features"] = with_features(
        f"SELECT raceId, driverId, {r6('qualifying_pos')} AS qualifying_pos, "
        f"{r6('grid_penalty_delta')} AS grid_penalty_delta FROM e1")
    q["w1_w2_event_extremes"] = with_features(
        f"SELECT raceId, {r6('min(driver_best_q_ms)')} AS pole_ms, {r6('max(driver_best_q_ms)')} AS slowest_ms, "
        f"{r6('max(pace_raw)')} AS slowest_pace_pct FROM e1 GROUP BY raceId")
    q["p12_pace_delta"] = with_features(f"SELECT raceId, driverId, {r6('pace_raw')} AS pace_delta_pct FROM e1")
    q["j3_peer_value"] = with_features(
        f"SELECT e1.raceId, e1.driverId, {r6('m.t_tm')} AS driver_best_q_ms_tm, {r6('m.pace_tm')} AS pace_delta_pct_tm, "
        f"{r6('m.pos_tm')} AS positionOrder_tm FROM e1 LEFT JOIN mates m "
        f"ON e1.raceId = m.raceId AND e1.driverId = m.driverId")
    q["p13_pace_fill"] = with_features(f"SELECT raceId, driverId, {r6('pace_delta_pct')} AS pace_delta_pct FROM e2")
    q["p14_teammate_delta"] = with_features(
        f"SELECT raceId, driverId, {r6('teammate_delta_pct')} AS teammate_delta_pct FROM e2")
    q["p15_h2h_win"] = with_features(f"SELECT raceId, driverId, {r6('h2h_win')} AS h2h_win FROM e2")
    q["w3_h2h_form"] = with_features(
        f"SELECT raceId, driverId, {r6('teammate_h2h_form')} AS teammate_h2h_form FROM e3")
    q["p16_weekend_reward"] = with_features(
        f"SELECT raceId, driverId, {r6('sprint_points')} AS sprint_points, "
        f"{r6('total_weekend_pts')} AS total_weekend_pts FROM e2")
    q["w4_driver_points_lag"] = with_features(
        f"SELECT raceId, driverId, {r6('driver_pts_lag')} AS driver_pts_lag FROM e3")
    q["a1_team_event_totals"] = with_features(
        f"SELECT season, round, constructorId, {r6('team_total')} AS team_total FROM team_tot")
    q["w5_team_points_lag"] = with_features(
        f"SELECT season, round, constructorId, {r6('team_pts_lag')} AS team_pts_lag FROM team_lag")
    q["a4_global_median"] = with_features(f"SELECT {r6('m')} AS median_outcome FROM med")
    q["w6_entity_form_raw"] = with_features(
        f"SELECT e2.raceId, e2.driverId, {r6('d.v')} AS form_raw FROM e2 "
        f"LEFT JOIN dform d ON e2.raceId = d.raceId AND e2.driverId = d.driverId")
    q["w7_team_form_raw"] = with_features(
        f"SELECT t.season, t.round, t.constructorId, {r6('c.v')} AS form_raw FROM team_tot t LEFT JOIN cform c "
        f"ON t.season = c.season AND t.round = c.round AND t.constructorId = c.constructorId")
    q["w12_period_first_seq"] = with_features("SELECT season, first_round FROM first_seq")
    q["w16_decayed_form"] = with_features(
        f"SELECT raceId, driverId, {r6('driver_form_ewma')} AS driver_form_ewma, "
        f"{r6('constructor_form_ewma')} AS constructor_form_ewma FROM e3")
    q["a6_venue_retention"] = with_features(
        f"SELECT circuitId, season, {r6('track_retention_idx')} AS track_retention_idx, "
        f"{r6('track_retention_confidence')} AS track_retention_confidence FROM retention_out")
    q["a7_global_retention"] = with_features(f"SELECT {r6('g')} AS global_retention FROM ret_global")
    q["a8_venue_event_rate"] = with_features(
        f"SELECT circuitId, season, {r6('circuit_dnf_rate_5yr')} AS circuit_dnf_rate_5yr FROM venue_rate")
    q["w8_w11_fail_rates"] = with_features(
        "SELECT raceId, driverId, " + ", ".join(
            f"{r6(c)} AS {c}" for c in ("driver_dnf_rate_10", "constructor_dnf_rate_10",
                                        "driver_team_dnf_rate_10", "pu_dnf_rate_10")) + " FROM matrix")
    q["p17_p19_labels"] = with_features(
        "SELECT raceId, driverId, regulatory_era, is_classified, pu_manufacturer FROM e1")
    q.update(metric_queries())
    q.update(string_queries())
    q.update(raw_queries())
    q["a3_group_sizes"] = with_features("SELECT raceId, count(*) AS entries FROM e2 GROUP BY raceId")
    q["p29_p30_extended_matrix"] = with_features(f"""
SELECT m.raceId, m.driverId,
  CAST(max(CASE WHEN m.sprint_finish IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY m.raceId) AS BIGINT)
    AS is_sprint_weekend,
  {r6('e.grid')} AS grid,
  {r6('m.driver_pts_lag / nullif(m.team_pts_lag, 0)')} AS team_point_contribution_pct,
  {r6('m.pace_delta_pct * (1.0 - m.track_retention_idx)')} AS pace_x_overtaking,
  {r6('e.grid * m.track_retention_idx')} AS grid_x_retention
FROM matrix m JOIN e2 e ON m.raceId = e.raceId AND m.driverId = e.driverId""")
    best = q["a17_best_params"]
    q["s8_params_artifact"] = (f"SELECT summer_break_round, off_season_decay, regulation_reset_decay, "
                               f"summer_break_decay, driver_reg_reset_decay FROM ({best})")
    return q


def raw_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    res = (f"SELECT raceId, season, round, circuitId, driverId, constructorId, status, {r6('grid')} AS grid, "
           f"{r6('positionOrder')} AS positionOrder, {r6('points')} AS points FROM fact_results "
           f"WHERE season >= {P.first_period}")
    q["p1_parse_results"] = f"WITH {ADAPTER_SQL_CTES}\n{res}"
    q["st1_ingest_incremental"] = f"WITH {ADAPTER_SQL_CTES}\n{res}"
    q["st1_ingest_merged"] = q["st1_ingest_incremental"]
    floor = f"WHERE raceId IN (SELECT raceId FROM fact_results WHERE season >= {P.first_period})"
    q["p2_parse_qualifying"] = (
        f"WITH {ADAPTER_SQL_CTES}\nSELECT raceId, driverId, {r6('qualifying_pos')} AS qualifying_pos, "
        f"{r6('q1_ms')} AS q1_ms, {r6('q2_ms')} AS q2_ms, {r6('q3_ms')} AS q3_ms, "
        f"{r6('driver_best_q_ms')} AS driver_best_q_ms FROM fact_qualifying {floor}")
    q["p3_parse_sprints"] = (
        f"WITH {ADAPTER_SQL_CTES}\nSELECT raceId, driverId, {r6('sprint_finish')} AS sprint_finish, "
        f"{r6('sprint_points')} AS sprint_points FROM fact_sprints {floor}")
    dirty = f"WITH {ADAPTER_SQL_CTES},\n{SOILED_SQL}"
    known = f"driverId IS NOT NULL AND season >= {P.first_period}"
    q["p1_p6_soiled_facts"] = (
        f"{dirty}\nSELECT raceId, season, round, circuitId, driverId, constructorId, status, grid, positionOrder, points "
        f"FROM soiled WHERE {known}")
    q["p10_soiled_starters"] = (
        f"{dirty}\nSELECT raceId, driverId, status, positionOrder, points FROM soiled WHERE {known} "
        "AND NOT coalesce(regexp_matches(status, '(?i)(dns|did not start)'), false)")
    q["u3_quarantine"] = f"""{dirty},
counted AS (
  SELECT 'facts' AS kind, count(*) + count(*) FILTER (kind = 5) AS n, count(*) AS kept FROM soiled WHERE {known}
  UNION ALL SELECT 'keyless_rows', count(*), NULL FROM soiled WHERE driverId IS NULL AND season >= {P.first_period}
  UNION ALL SELECT 'bad_pages', count(DISTINCT raceId), NULL FROM soiled WHERE round % 5 = 0
)
SELECT kind, n AS observed, n AS stored, kept FROM counted"""
    q["s2_missing_pages"] = f"""WITH {ADAPTER_SQL_CTES},
ev AS (SELECT DISTINCT raceId, season, round FROM fact_results),
tot AS (
  SELECT raceId, 'results' AS kind, count(*) AS n FROM fact_results GROUP BY raceId
  UNION ALL SELECT raceId, 'qualifying', count(*) FROM fact_qualifying GROUP BY raceId
  UNION ALL SELECT raceId, 'sprint', count(*) FROM fact_sprints GROUP BY raceId
),
pages AS (SELECT raceId, kind, unnest(range(0, CAST((n + 24) // 25 AS BIGINT))) AS page FROM tot)
SELECT 'race_' || season || '_' || round || '_' || kind AS prefix, CAST(page * 25 AS BIGINT) AS offset
FROM pages JOIN ev USING (raceId) WHERE page % 3 = 1"""
    q["s3_pending_requests"] = f"""WITH {ADAPTER_SQL_CTES},
ev AS (SELECT DISTINCT raceId, season, round FROM fact_results),
landed AS (
  SELECT season, round, 'results' AS endpoint FROM ev
  UNION SELECT e.season, e.round, 'qualifying' FROM ev e WHERE e.raceId IN (SELECT raceId FROM fact_qualifying)
  UNION SELECT e.season, e.round, 'sprint' FROM ev e WHERE e.raceId IN (SELECT raceId FROM fact_sprints)
)
SELECT season, round, endpoint FROM ev, (VALUES ('results'), ('qualifying'), ('sprint')) t(endpoint)
EXCEPT SELECT season, round, endpoint FROM landed"""
    q["s4_active_entities"] = f"WITH {ADAPTER_SQL_CTES}\nSELECT DISTINCT driverId AS id FROM fact_results"
    q["s4_active_constructors"] = f"WITH {ADAPTER_SQL_CTES}\nSELECT DISTINCT constructorId AS id FROM fact_results"
    q["s5_event_universe"] = f"""WITH {ADAPTER_SQL_CTES}
SELECT DISTINCT season, round FROM fact_results
WHERE season >= {P.first_period}
  AND driverId IN (SELECT driverId FROM fact_results WHERE season = (SELECT max(season) FROM fact_results))"""
    q["s5_race_lists"] = q["s5_event_universe"]
    return q


TEST = P.test_period


def _pct(num: str, k: int) -> str:
    return f"(CASE WHEN events > 0 THEN {num} / (events * {k}) * 100.0 ELSE 0.0 END)"


def metric_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    t = f"""t AS (
  SELECT raceId, driverId, positionOrder AS target, qualifying_pos, grid, driver_pts_lag, driver_form_ewma,
         driver_dnf_rate_10, is_classified,
         CAST(rank() OVER (PARTITION BY raceId ORDER BY driver_pts_lag DESC) AS BIGINT) AS champ,
         CAST(rank() OVER (PARTITION BY raceId ORDER BY driver_form_ewma ASC) AS BIGINT) AS form_rank
  FROM (SELECT e4.*, coalesce(d_rate, {P.dnf_rate_fill}) AS driver_dnf_rate_10 FROM e4) WHERE season = {TEST}
)"""
    q["m8_compare_strategies"] = with_features(f""", {t},
lg AS (
  SELECT raceId, target, 'grid' AS strategy, CAST(grid AS DOUBLE) AS pred FROM t
  UNION ALL SELECT raceId, target, 'qualifying', CAST(qualifying_pos AS DOUBLE) FROM t
  UNION ALL SELECT raceId, target, 'championship', CAST(champ AS DOUBLE) FROM t
),
flat AS (
  SELECT strategy, count(DISTINCT raceId) AS events,
    avg(abs({points_case('target')} - {points_case('pred')})) AS exp_pts_err,
    sum(CASE WHEN target = 1 AND pred = 1 THEN 1 ELSE 0 END) AS p1,
    sum(CASE WHEN target <= 3 AND pred <= 3 THEN 1 ELSE 0 END) AS t3,
    sum(CASE WHEN target <= 10 AND pred <= 10 THEN 1 ELSE 0 END) AS t10
  FROM lg GROUP BY strategy
),
rk AS (
  SELECT strategy, raceId,
    rank() OVER (PARTITION BY strategy, raceId ORDER BY target)
      + (count(*) OVER (PARTITION BY strategy, raceId, target) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY strategy, raceId ORDER BY pred)
      + (count(*) OVER (PARTITION BY strategy, raceId, pred) - 1) / 2.0 AS rb
  FROM lg WHERE target IS NOT NULL AND pred IS NOT NULL
),
rho AS (
  SELECT strategy, avg(r) AS spearman_rho FROM (
    SELECT strategy, raceId, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS r
    FROM rk GROUP BY strategy, raceId) GROUP BY strategy
),
mae AS (
  SELECT strategy, avg(m) AS mae FROM (
    SELECT strategy, raceId, avg(abs(target - pred)) AS m FROM lg GROUP BY strategy, raceId) GROUP BY strategy
)
SELECT f.strategy, f.events, {r6('exp_pts_err')} AS exp_pts_err, {r6(_pct('p1', 1))} AS p1_acc,
  {r6(_pct('t3', 3))} AS top3_acc, {r6(_pct('t10', 10))} AS top10_acc,
  {r6('coalesce(spearman_rho, 0.0)')} AS spearman_rho, {r6('coalesce(mae, 0.0)')} AS mae
FROM flat f LEFT JOIN rho USING (strategy) LEFT JOIN mae USING (strategy)""".replace("WITH \n, ", "WITH "))
    m8 = q["m8_compare_strategies"]
    q["m3_two_stage"] = (
        f"SELECT strategy, events, true AS in_range, exp_pts_err, p1_acc, top3_acc, top10_acc, spearman_rho, mae "
        f"FROM ({m8}) UNION ALL SELECT m.name, b.events, true, NULL, NULL, NULL, NULL, NULL, NULL "
        f"FROM ({m8}) b, (VALUES ('single_stage'), ('two_stage')) m(name) WHERE b.strategy = 'grid'")
    per_event = f"FROM matrix WHERE season = {TEST} GROUP BY raceId"
    q["m1_fit_ranker"] = with_features(
        "SELECT raceId, count(*) AS entries, CAST(1 AS BIGINT) AS first_pos, true AS ranks_follow, "
        f"true AS beats_random {per_event}")
    q["m1_listwise_ranker"] = q["m1_fit_ranker"]
    rates = ", ".join(
        f"""(SELECT (coalesce(sum(b.v), 0) + 20.0 * e.prior) / (coalesce(sum(b.n), 0) + 20.0) FROM cat_{c} b
             WHERE b.k IS NOT DISTINCT FROM e.{c} AND (b.season, b.round) < (e.season, e.round)) AS {c}__rate"""
        for c in ("driverId", "constructorId", "circuitId", "pu_manufacturer", "regulatory_era"))
    cats = ", ".join(
        f"""cat_{c} AS (SELECT {c} AS k, season, round, count(*) AS n, sum(is_classified) AS v FROM e2
            WHERE season < {TEST} GROUP BY ALL)"""
        for c in ("driverId", "constructorId", "circuitId", "pu_manufacturer", "regulatory_era"))
    columns = ", ".join(f"{r6(c + '__rate')} AS {c}__rate"
                        for c in ("driverId", "constructorId", "circuitId", "pu_manufacturer", "regulatory_era"))
    q["p25_category_rates"] = with_features(f""", {cats},
per_event AS (SELECT season, round, count(*) FILTER (season < {TEST}) AS n,
                     coalesce(sum(is_classified) FILTER (season < {TEST}), 0) AS v FROM e2 GROUP BY season, round),
priors AS (SELECT a.season, a.round, coalesce((SELECT sum(b.v) / nullif(sum(b.n), 0) FROM per_event b
             WHERE (b.season, b.round) < (a.season, a.round)), 0.5) AS prior FROM per_event a),
e AS (SELECT e2.*, p.prior FROM e2 JOIN priors p USING (season, round)),
rated AS (SELECT raceId, driverId, {rates} FROM e)
SELECT raceId, driverId, {columns} FROM rated""".replace("WITH \n, ", "WITH "))
    q["s6_partitioned_matrix"] = with_features(f"""
SELECT CASE WHEN season < {TEST} THEN 'train' ELSE 'test' END AS split, season, count(*) AS rows,
       sum(positionOrder) AS positions, CAST(CASE WHEN season >= {TEST} - 1 THEN 2 ELSE 1 END AS BIGINT) AS oldest,
       CAST(CASE WHEN season >= {TEST} - 1 THEN 2 ELSE 1 END AS BIGINT) AS newest
FROM e2 WHERE season <= {TEST} AND (season < {TEST} - 1 OR positionOrder <= 10) GROUP BY season""")
    q["p28_merge_stages"] = with_features(f"""
SELECT raceId, driverId,
       rank() OVER (PARTITION BY raceId ORDER BY is_classified DESC,
                    CASE WHEN is_classified = 1 THEN s ELSE p END DESC NULLS LAST) AS two_stage_pred_pos,
       rank() OVER (PARTITION BY raceId ORDER BY s DESC NULLS LAST) AS single_stage_pred_pos
FROM (SELECT *, (-grid) % 17 AS s, CASE WHEN grid % 5 <> 0 THEN (positionOrder % 7) / 10 END AS p
      FROM e2 WHERE season = {TEST})""")
    q["m2_classifier"] = with_features(
        "SELECT raceId, count(*) AS entries, CAST(sum(is_classified) AS BIGINT) AS classified, true AS flags_follow, "
        f"true AS beats_coin {per_event}")
    folds = ", ".join(f"({v})" for v in P.validation_periods)
    q["m4_chrono_cv"] = with_features(f""", vf AS (SELECT * FROM (VALUES {folds}) t(fold)),
vr AS (
  SELECT fold, raceId, driverId, positionOrder AS target, CAST(qualifying_pos AS DOUBLE) AS pace
  FROM vf JOIN matrix ON season = fold
),
vk AS (
  SELECT fold, raceId,
    rank() OVER (PARTITION BY fold, raceId ORDER BY target)
      + (count(*) OVER (PARTITION BY fold, raceId, target) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY fold, raceId ORDER BY pace)
      + (count(*) OVER (PARTITION BY fold, raceId, pace) - 1) / 2.0 AS rb
  FROM vr WHERE target IS NOT NULL AND pace IS NOT NULL
),
vrho AS (
  SELECT fold, avg(r) AS pace_rho FROM (
    SELECT fold, raceId, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS r
    FROM vk GROUP BY fold, raceId) GROUP BY fold
)
SELECT CAST(vf.fold AS BIGINT) AS fold,
  (SELECT count(DISTINCT raceId) FROM vr WHERE vr.fold = vf.fold) AS events,
  (SELECT count(*) FROM matrix WHERE season < vf.fold) AS train_rows,
  (SELECT count(*) FROM vr WHERE vr.fold = vf.fold) AS val_rows,
  (SELECT count(*) FROM vr WHERE vr.fold = vf.fold) AS scored_rows,
  {r6('coalesce(pace_rho, 0.0)')} AS pace_rho, true AS in_range
FROM vf LEFT JOIN vrho USING (fold)""".replace("WITH \n, ", "WITH "))
    q["m6_leakage_alarm"] = with_features(
        "SELECT 'clean' AS matrix, false AS alarm, CAST(NULL AS VARCHAR) AS named, count(*) AS rows FROM matrix "
        "UNION ALL SELECT 'planted', true, 'planted_outcome', count(*) FROM matrix")
    q["m7_t2_importances"] = (
        "SELECT CAST(range AS BIGINT) AS rank, true AS known, true AS descending, true AS complete FROM range(1, 11)")
    q["w14_w15_rank"] = with_features(f""", {t}
SELECT raceId, driverId, champ AS championship_pred_pos, form_rank AS form_pred_pos FROM t""")
    cuts = P.ndcg_cuts
    dcg = ", ".join(
        f"sum(CASE WHEN rk <= {k} THEN gain / log2(rk + 1.0) ELSE 0.0 END) AS d{k}, "
        f"sum(CASE WHEN ideal <= {k} THEN gain / log2(ideal + 1.0) ELSE 0.0 END) AS i{k}" for k in cuts)
    q["a13_ndcg"] = with_features(f""", {t},
rr AS (
  SELECT raceId, CAST({relevance_case('target')} AS DOUBLE) AS gain,
    row_number() OVER (PARTITION BY raceId ORDER BY driver_pts_lag DESC, driverId) AS rk,
    row_number() OVER (PARTITION BY raceId ORDER BY {relevance_case('target')} DESC, driverId) AS ideal
  FROM t
),
per AS (SELECT raceId, {dcg} FROM rr GROUP BY raceId)
SELECT {", ".join(f"{r6(f'avg(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 1.0 END)')} AS ndcg_{k}" for k in cuts)}
FROM per""")
    prof = (f"count(DISTINCT raceId) AS events, count(*) AS rows, "
            f"{r6('avg(1.0 - is_classified)')} AS dnf_rate")
    q["a15_split_profile"] = with_features(
        f"SELECT 'train' AS split, min(season) AS min_period, max(season) AS max_period, {prof} "
        f"FROM matrix WHERE season < {TEST} UNION ALL "
        f"SELECT 'test' AS split, min(season), max(season), {prof} FROM matrix WHERE season = {TEST}")
    q["a16_classification_accuracy"] = with_features(
        f"SELECT {r6(f'avg(CAST((CASE WHEN 1.0 - driver_dnf_rate_10 >= {P.classify_threshold} THEN 1 ELSE 0 END) = is_classified AS DOUBLE)) * 100.0')} "
        f"AS accuracy FROM matrix WHERE season = {TEST}")
    q["m5_sweep_decay"] = with_features(_sweep_ctes() + f"""
SELECT g.combo_id, g.summer_break_round, f.folds, {r6('g.off_season_decay')} AS off_season_decay,
  {r6('g.regulation_reset_decay')} AS regulation_reset_decay, {r6('g.summer_break_decay')} AS summer_break_decay,
  {r6('g.driver_reg_reset_decay')} AS driver_reg_reset_decay, {r6('f.err')} AS mean_exp_pts_err
FROM (SELECT combo_id, avg(err) AS err, count(*) AS folds FROM folds GROUP BY combo_id) f JOIN grid g USING (combo_id)""")
    q["m5_sweep_models"] = with_features(f"""
SELECT CAST(a * 6 + b * 3 + c AS BIGINT) AS combo_id, CASE a WHEN 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS off_season_decay,
       CASE b WHEN 0 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS regulation_reset_decay, CAST(7 + c AS BIGINT) AS summer_break_round,
       (SELECT count(DISTINCT season) FROM e2 WHERE season IN ({", ".join(map(str, P.validation_periods))})) AS folds,
       CAST(a * 6 + b * 3 AS BIGINT) AS same_as, TRUE AS error_in_points
FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1), (2)) z(c)""")
    q["a17_best_params"] = with_features(_sweep_ctes() + f""",
per AS (SELECT combo_id, avg(err) AS err FROM folds GROUP BY combo_id)
SELECT g.combo_id, g.summer_break_round, {r6('g.off_season_decay')} AS off_season_decay,
  {r6('g.regulation_reset_decay')} AS regulation_reset_decay, {r6('g.summer_break_decay')} AS summer_break_decay,
  {r6('g.driver_reg_reset_decay')} AS driver_reg_reset_decay, {r6('p.err')} AS mean_exp_pts_err
FROM per p JOIN grid g USING (combo_id) ORDER BY round(p.err, 9), g.combo_id LIMIT 1""")
    rates = ", ".join(
        f"""{name} AS (
  SELECT {key}, raceId, sum(s) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS rate
  FROM (SELECT {key}, season, round, raceId, sum(is_dnf) AS s, count(*) AS n FROM e3 GROUP BY ALL)
  WINDOW w AS (PARTITION BY {key} ORDER BY season, round ROWS BETWEEN {P.reliability_window} PRECEDING AND 1 PRECEDING))"""
        for name, key in (("tr", "constructorId"), ("sr", "pu_manufacturer")))
    q["w9_w11_event_rates"] = with_features(f""", {rates}
SELECT e3.raceId, e3.driverId, {r6('tr.rate')} AS team_rate, {r6('sr.rate')} AS supplier_rate
FROM e3 JOIN tr ON tr.raceId = e3.raceId AND tr.constructorId = e3.constructorId
JOIN sr ON sr.raceId = e3.raceId AND sr.pu_manufacturer = e3.pu_manufacturer""")
    q["a4_a7_as_of_period"] = with_features(f"""
SELECT (SELECT {r6('quantile_cont(positionOrder, 0.5)')} FROM e2 WHERE season < {TEST}) AS median_outcome,
  (SELECT {r6(f'coalesce(avg(rho), {P.retention_fill})')} FROM ret_base
   WHERE season < {TEST} AND n_rows >= {P.retention_global_min_rows} AND rho IS NOT NULL) AS global_retention""")
    q["a18_distinct_counts"] = with_features(
        "SELECT circuitId, count(DISTINCT season) AS periods, count(DISTINCT raceId) AS events, "
        "count(DISTINCT driverId) AS entities FROM e2 GROUP BY circuitId")
    return q


def _sweep_ctes() -> str:
    names = list(SWEEP_GRID)
    vals = []
    for i, (name, values) in enumerate(SWEEP_GRID.items()):
        rows = ", ".join(f"({j}, {v})" for j, v in enumerate(values))
        vals.append(f"(VALUES {rows}) v{i}(i{i}, {name})")
    cid = "0"
    for i, (name, values) in enumerate(SWEEP_GRID.items()):
        cid = f"({cid}) * {len(values)} + i{i}"
    vp = ", ".join(str(v) for v in P.validation_periods)
    return f""",
grid AS (SELECT CAST({cid} AS BIGINT) AS combo_id, {", ".join(names)} FROM {" CROSS JOIN ".join(vals)}),
sin AS (
  SELECT e2.raceId, e2.season, e2.round, e2.positionOrder, d.v AS dv, cf.v AS cv, fs.first_round
  FROM e2
  LEFT JOIN dform d ON e2.raceId = d.raceId AND e2.driverId = d.driverId
  LEFT JOIN cform cf ON e2.season = cf.season AND e2.round = cf.round AND e2.constructorId = cf.constructorId
  LEFT JOIN first_seq fs ON e2.season = fs.season
  WHERE e2.season IN ({vp})
),
x AS (
  SELECT g.combo_id, s.raceId, s.season, s.positionOrder,
    coalesce(s.cv, 0.0)
      * (CASE WHEN s.round = s.first_round THEN g.off_season_decay ELSE 1.0 END)
      * (CASE WHEN s.round = s.first_round AND s.season IN {RESETS} THEN g.regulation_reset_decay ELSE 1.0 END)
      * (CASE WHEN s.round = g.summer_break_round THEN g.summer_break_decay ELSE 1.0 END)
    - coalesce(s.dv, (SELECT m FROM med))
      * (CASE WHEN s.season IN {RESETS} AND s.round = s.first_round THEN g.driver_reg_reset_decay ELSE 1.0 END)
      AS score
  FROM sin s CROSS JOIN grid g
),
xr AS (
  SELECT combo_id, season, positionOrder,
    rank() OVER (PARTITION BY combo_id, raceId ORDER BY score DESC) AS pred
  FROM x
),
folds AS (
  SELECT combo_id, season, avg(abs({points_case('positionOrder')} - {points_case('pred')})) AS err
  FROM xr GROUP BY combo_id, season
)"""


def tonum(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMERIC_PATTERN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def lap_ms(x: str) -> str:
    parts = f"string_split({x}, ':')"
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' OR {x} = '\\N' THEN NULL "
            f"WHEN len({parts}) = 2 THEN {tonum(f'{parts}[1]')} * 60000.0 + {tonum(f'{parts}[2]')} * 1000.0 "
            f"WHEN len({parts}) = 1 THEN {tonum(x)} * 1000.0 END)")


def string_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["p8_p9_lap_time_ms"] = f"""WITH {STRINGS_SQL_CTE},
l AS (SELECT l_orderkey, l_linenumber, {lap_ms('lap')} AS q1_ms, {lap_ms('lap_short')} AS q2_ms,
             {lap_ms('numtxt')} AS q3_ms FROM strs)
SELECT l_orderkey, l_linenumber, {r6('q1_ms')} AS q1_ms, {r6('q2_ms')} AS q2_ms, {r6('q3_ms')} AS q3_ms,
       {r6('least(q1_ms, q2_ms, q3_ms)')} AS best_ms FROM l"""
    q["p6_p7_numeric_coercion"] = f"""WITH {STRINGS_SQL_CTE},
c AS (SELECT l_orderkey, l_linenumber, CASE WHEN numtxt <> '\\N' THEN numtxt END AS clean_txt FROM strs),
n AS (SELECT *, {tonum('clean_txt')} AS num FROM c)
SELECT l_orderkey, l_linenumber, clean_txt, {r6('num')} AS num,
       coalesce(CASE WHEN num = floor(num) THEN CAST(num AS BIGINT) END, 0) AS int_or_zero FROM n"""
    q["p4_event_key"] = (f"WITH {ADAPTER_SQL_CTES}\nSELECT DISTINCT CAST(season AS VARCHAR) || '_' || "
                         f"CAST(round AS VARCHAR) AS key, raceId FROM fact_results")
    q["p20_p22_position_maps"] = (f"WITH {ADAPTER_SQL_CTES}\nSELECT raceId, driverId, "
                                  f"CAST({relevance_case('positionOrder')} AS BIGINT) AS relevance, "
                                  f"{r6(points_case('grid'))} AS grid_points FROM fact_results")
    return q
