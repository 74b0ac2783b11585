"""Numeric column functions.

All are native Spark expressions, so they stay inside whole-stage codegen.
Money is compared as DECIMAL: measures are cast to ``MEASURE_TYPE`` before
summing, which makes sums exact and independent of partition order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOLERANCE = 0.005              # |computed - reported| <= TOLERANCE * |reported|
MEASURE_TYPE = "decimal(20,4)"  # input cast before SUM
VALUE_TYPE = "decimal(38,6)"    # printed / reported values
UNIT_SCALE = {"mm": 1_000_000, "bn": 1_000_000_000, "USD millions": 1_000_000, "USD billions": 1_000_000_000, "%": 1, "count": 1}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relative_error(computed, reported) -> Column:
    """``|c - r| / |r|``; when ``r = 0`` the error is ``|c|``. NULL when
    either side is NULL (not evaluable)."""
    c, r = _c(computed).cast("double"), _c(reported).cast("double")
    return F.when(r == 0, F.abs(c)).otherwise(F.abs(c - r) / F.abs(r))


def within_tolerance(computed, reported, tol: float = TOLERANCE) -> Column:
    """J3 predicate, evaluated in DECIMAL so the edge (1004.9 vs 1005.1 on
    1000) is exact. NULL computed never matches."""
    c, r = _c(computed).cast("decimal(38,6)"), _c(reported).cast("decimal(38,6)")
    t = F.lit(tol).cast("decimal(10,6)")
    ok = F.when(r == 0, c == 0).otherwise(F.abs(c - r) <= t * F.abs(r))
    return F.coalesce(ok, F.lit(False))


def combine(op, lhs, rhs) -> Column:
    """two-term arithmetic after aggregation; division by zero is NULL."""
    a, b = _c(lhs).cast("decimal(38,6)"), _c(rhs).cast("decimal(38,6)")
    o = _c(op)
    return (F.when(o == "+", a + b)
             .when(o == "-", a - b)
             .when(o == "/", F.try_divide(a, b)))


def unit_scale(unit) -> Column:
    """Multiplier for a printed unit; unknown units scale by 1."""
    u = _c(unit)
    expr = F.lit(1)
    for k, v in UNIT_SCALE.items():
        expr = F.when(u == k, F.lit(v)).otherwise(expr)
    return expr.cast("decimal(20,0)")


def raw_value(value, unit) -> Column:
    return (_c(value).cast(VALUE_TYPE) * unit_scale(unit)).cast(VALUE_TYPE)


# Fixed value: a printed number.
NUMBER_PATTERN = r"^-?[\d,]+(?:\.\d+)?$"


def parse_number(text) -> Column:
    """F8: ``-?[\\d,]+(.\\d+)?`` to DECIMAL, else NULL."""
    t = F.trim(_c(text))
    return F.when(t.rlike(NUMBER_PATTERN),
                  F.regexp_replace(t, ",", "").try_cast(VALUE_TYPE))


def parse_long_date(text) -> Column:
    """``Month d, yyyy`` to DATE, else NULL."""
    return F.to_date(F.try_to_timestamp(F.trim(_c(text)), F.lit("MMMM d, yyyy")))
