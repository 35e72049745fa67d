"""Column-level functions (all built-in expressions, no Python UDFs)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import POINTS_BY_POSITION, RELEVANCE_BY_POSITION, RELEVANCE_DEFAULT

# A plain decimal number with optional sign, fraction and exponent, optionally
# surrounded by blanks. Spark's cast also takes suffixes such as "3D"/"3L" and
# the word "nan"; the reference's numeric coercion does not, so we guard.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NULL_TOKEN = "\\N"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """String -> double; anything that is not a plain number becomes null."""
    c = _c(c)
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def to_int(c, default: int | None = None) -> Column:
    """Integer parse of a string member; unparsable -> default."""
    v = to_number(c)
    v = F.when(v == F.floor(v), v.cast("bigint"))
    return F.coalesce(v, F.lit(default).cast("bigint")) if default is not None else v


def normalize_null(c) -> Column:
    """Whole-cell literal ``\\N`` -> null."""
    c = _c(c)
    return F.when(c != F.lit(NULL_TOKEN), c)


def event_key(period, seq) -> Column:
    """Composite event id ``"{period}_{seq}"``."""
    return F.concat_ws("_", _c(period).cast("string"), _c(seq).cast("string"))


def lap_time_ms(c) -> Column:
    """Lap time string -> milliseconds.

    ``m:ss.fff`` -> m*60000 + s*1000; ``ss.fff`` -> s*1000; null, empty,
    ``\\N``, three or more parts or non-numeric parts -> null.
    """
    c = _c(c)
    parts = F.split(c, ":", -1)
    n = F.size(parts)
    p0 = to_number(F.get(parts, 0))
    p1 = to_number(F.get(parts, 1))
    usable = c.isNotNull() & (c != F.lit("")) & (c != F.lit(NULL_TOKEN))
    return F.when(usable & (n == 2), p0 * F.lit(60000.0) + p1 * F.lit(1000.0)) \
            .when(usable & (n == 1), p0 * F.lit(1000.0))


def best_of(*cols) -> Column:
    """Smallest non-null value (P9); null when all are null."""
    return F.least(*[_c(c) for c in cols])


def non_starter(status) -> Column:
    """True for did-not-start rows (P10): case-insensitive ``DNS`` or
    ``Did not start`` anywhere in the status; null status is kept."""
    return F.coalesce(_c(status).rlike("(?i)(dns|did not start)"), F.lit(False))


def classified_flag(status) -> Column:
    """1 when status is ``Finished`` or contains ``Lap`` (case-sensitive), else 0."""
    s = _c(status)
    return F.coalesce((s == F.lit("Finished")) | s.contains("Lap"), F.lit(False)).cast("bigint")


def era_of(period, eras: Sequence, default: str) -> Column:
    """Ordered range lookup period -> label."""
    p = _c(period)
    expr = None
    for lo, hi, label in eras:
        cond = (p >= F.lit(lo)) & (p <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def map_by_period_rules(key, period, rules: Sequence, default: str) -> Column:
    """Ordered rule table (ids, period ranges, label); first match wins.

    The key is lower-cased; a null key matches no rule (-> default).
    """
    k = F.lower(_c(key).cast("string"))
    p = _c(period)
    expr = None
    for ids, ranges, label in rules:
        in_range = None
        for lo, hi in ranges:
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (p >= F.lit(lo))
            if hi is not None:
                cond = cond & (p <= F.lit(hi))
            in_range = cond if in_range is None else (in_range | cond)
        cond = k.isin(list(ids)) & in_range
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    out = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return F.when(k.isNull(), F.lit(default)).otherwise(out)


def _position_lookup(pos, values: Sequence, default) -> Column:
    """Value by 1-based integer position via a literal array.

    Position is truncated to an integer first (the reference casts to int).
    """
    arr = F.array(*[F.lit(v) for v in values])
    idx = _c(pos).cast("double")
    i = F.when(idx.isNotNull(), F.floor(F.abs(idx)) * F.signum(idx)).cast("int")
    return F.coalesce(F.try_element_at(arr, F.when(i >= 1, i)), F.lit(default))


def relevance_of(pos) -> Column:
    """Finishing position -> relevance label; outside 1..20 -> 1 (P20)."""
    return _position_lookup(pos, RELEVANCE_BY_POSITION, RELEVANCE_DEFAULT).cast("bigint")


def points_of(pos) -> Column:
    """Finishing position -> championship points; outside 1..10 or null -> 0."""
    return _position_lookup(pos, POINTS_BY_POSITION, 0.0).cast("double")
