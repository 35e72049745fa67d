"""Panel roles and the single parameter object.

A *panel* is a table of entries: one row per (event, entity). Events are
ordered chronologically by (period, seq); entities belong to a team for the
event; events happen at a venue. ``PanelSpec`` maps these roles to column
names so that no operator hard-codes a domain. ``Params`` carries every
constant the feature builders, metrics and model runners use; all windows,
thresholds and fills are read from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

@dataclass(frozen=True)
class PanelSpec:
    event: str = "raceId"
    period: str = "season"
    seq: str = "round"
    venue: str = "circuitId"
    entity: str = "driverId"
    team: str = "constructorId"
    supplier: str = "pu_manufacturer"
    outcome: str = "positionOrder"
    start: str = "grid"
    trial_time: str = "driver_best_q_ms"
    reward: str = "points"
    status: str = "status"

    @property
    def chrono(self) -> list[str]:
        """Deterministic chronological order of entries (unique per row)."""
        return [self.period, self.seq, self.outcome, self.entity]


# Fixed values that must equal the reference for identical results.
# Relevance label by finishing position 1..20; any other position -> 1.
RELEVANCE_BY_POSITION = (
    2500, 1800, 1500, 1200, 1000, 800, 600, 400, 200, 100,
    50, 40, 30, 25, 20, 15, 10, 8, 5, 2,
)
RELEVANCE_DEFAULT = 1
# Championship points by finishing position 1..10; any other position -> 0.
POINTS_BY_POSITION = (25.0, 18.0, 15.0, 12.0, 10.0, 8.0, 6.0, 4.0, 2.0, 1.0)

# Regulatory eras (first season, last season, label); anything else -> default.
ERAS = ((2014, 2021, "V6_Hybrid_v1"), (2022, 2025, "Ground_Effect"))
ERA_DEFAULT = "2026_Reset"

# Supplier rules, tested in order, first match wins:
# (team ids, list of (from season, to season) ranges, label); None = open end.
SUPPLIER_RULES = (
    (("mercedes", "williams"), ((None, None),), "mercedes"),
    (("force_india", "racing_point"), ((None, 2020),), "mercedes"),
    (("aston_martin",), ((2021, 2025),), "mercedes"),
    (("mclaren",), ((2014, 2014), (2021, None)), "mercedes"),
    (("lotus_f1",), ((2015, 2015),), "mercedes"),
    (("manor",), ((2016, 2016),), "mercedes"),
    (("alpine",), ((2026, None),), "mercedes"),
    (("ferrari", "haas"), ((None, None),), "ferrari"),
    (("sauber", "alfa"), ((None, 2025), (2027, None)), "ferrari"),
    (("marussia", "manor"), ((None, 2015),), "ferrari"),
    (("toro_rosso",), ((2016, 2016),), "ferrari"),
    (("cadillac",), ((2026, None),), "ferrari"),
    (("red_bull", "toro_rosso", "alphatauri", "rb"), ((2019, None),), "honda_rbpt"),
    (("toro_rosso", "alphatauri", "rb"), ((2018, 2018),), "honda_rbpt"),
    (("mclaren",), ((2015, 2017),), "honda_rbpt"),
    (("aston_martin",), ((2026, None),), "honda_rbpt"),
    (("renault",), ((None, None),), "renault"),
    (("alpine",), ((None, 2025),), "renault"),
    (("red_bull", "toro_rosso", "caterham", "lotus_f1"), ((None, 2018),), "renault"),
    (("mclaren",), ((2018, 2020),), "renault"),
    (("audi",), ((None, None),), "audi"),
    (("sauber",), ((2026, None),), "audi"),
)
SUPPLIER_DEFAULT = "other"

# Fixed names: canonical model features, target and categorical columns.
FEATURES = (
    "qualifying_pos", "grid_penalty_delta", "pace_delta_pct",
    "teammate_delta_pct", "teammate_h2h_form", "sprint_finish",
    "driver_pts_lag", "team_pts_lag", "driver_form_ewma",
    "constructor_form_ewma", "track_retention_idx",
    "track_retention_confidence", "driver_dnf_rate_10",
    "constructor_dnf_rate_10", "driver_team_dnf_rate_10", "pu_dnf_rate_10",
    "circuit_dnf_rate_5yr",
)
TARGET = "positionOrder"
CATEGORICAL = ("circuitId", "driverId", "constructorId", "regulatory_era")


@dataclass(frozen=True)
class Params:
    first_period: int = 2014
    test_period: int = 2026
    validation_periods: tuple[int, ...] = (2020, 2021, 2022, 2023, 2024, 2025)
    reset_periods: tuple[int, ...] = (2022, 2026)
    summer_seq: int = 13
    # form decay factors
    off_season_decay: float = 0.3
    regulation_reset_decay: float = 0.05
    summer_break_decay: float = 0.7
    driver_reg_reset_decay: float = 0.7
    ewma_alpha: float = 0.4
    # fills
    dnf_rate_fill: float = 0.17
    retention_fill: float = 0.55
    teammate_delta_fill: float = 1.5
    pace_fill: float = 5.0
    pace_margin: float = 1.0
    h2h_cutoff: float = 15.0
    h2h_fill: float = 0.5
    # windows and row thresholds
    retention_window: int = 5
    retention_min_rows: int = 10
    retention_global_min_rows: int = 5
    venue_rate_window: int = 5
    venue_rate_min_rows: int = 10
    reliability_window: int = 10
    # "rows" = reference semantics (row frame, team-mates of the same event
    # are visible); "events" = leak-free frame over whole earlier events.
    reliability_mode: str = "rows"
    # restrict the global median / global retention mean to periods < this
    # (None = all periods, the reference's behaviour)
    as_of_period: int | None = None
    # lookup tables
    eras: tuple = ERAS
    era_default: str = ERA_DEFAULT
    supplier_rules: tuple = SUPPLIER_RULES
    supplier_default: str = SUPPLIER_DEFAULT
    # model / metrics
    classify_threshold: float = 0.5
    ndcg_cuts: tuple[int, ...] = (1, 3, 10)
    leakage_threshold: float = 0.85
    seed: int = 42

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# Sweep ranges for the decay parameters (fixed values of the reference).
SWEEP_GRID = {
    "off_season_decay": (0.3, 0.5, 0.7, 0.9),
    "regulation_reset_decay": (0.05, 0.1, 0.2, 0.4),
    "summer_break_decay": (0.7, 0.85, 1.0),
    "driver_reg_reset_decay": (0.1, 0.3, 0.5, 0.7),
    "summer_break_round": (13, 14, 15),
}


# ---------------------------------------------------------------------------
# Defaults for the panel derived from the driver's star-schema tables
# (seasons 1995..2001, rounds = months).  Same shape as the tables above.
ADAPTER_ERAS = ((1995, 1997, "era_a"), (1998, 2000, "era_b"))
ADAPTER_SUPPLIER_RULES = (
    (("n0", "n1"), ((None, None),), "sup_a"),
    (("n2",), ((None, 1997),), "sup_a"),
    (("n2", "n3"), ((1998, None),), "sup_b"),
    (("n4", "n5"), ((None, 1998), (2001, None)), "sup_b"),
    (("n6",), ((None, None),), "sup_c"),
    (("n7", "n8"), ((1996, 1999),), "sup_c"),
)


# Sweep ranges whose every parameter acts on the adapter's rounds 1 to 12.
ADAPTER_SWEEP_GRID = {**SWEEP_GRID, "summer_break_round": (7, 8, 9)}


def adapter_params(**kw) -> Params:
    base = Params(
        first_period=1996,  # the oldest rows, of 1995, lie below the floor
        test_period=2001,
        validation_periods=(1997, 1998, 1999, 2000),
        reset_periods=(1998, 2001),
        summer_seq=8,
        eras=ADAPTER_ERAS,
        era_default="era_c",
        supplier_rules=ADAPTER_SUPPLIER_RULES,
    )
    return replace(base, **kw)
