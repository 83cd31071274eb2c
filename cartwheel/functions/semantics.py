"""Column helpers that pin down the dialect semantics the reports depend on.

Every helper returns a ``Column`` built from Spark built-ins, so it stays inside

* division by zero is never an error: ``ratio(..., on_zero=None)`` gives NULL (the
  unguarded MySQL form), ``on_zero=0.0`` gives 0 (the ``CASE WHEN d = 0 THEN 0`` form);
* ratios are computed as DOUBLE / DOUBLE so every engine gives the same bits;
* period keys are strings (``date_format``), month names are full English names;
* half-to-even rounding uses ``bround`` or exact integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period key patterns used by the reports.
DAY = "yyyy-MM-dd"
MONTH = "yyyy-MM"
MONTH_START = "yyyy-MM-01"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    return _c(c).cast("double")


def money(c) -> Column:
    """Exact money type used for sums: decimal(18,2)."""
    return _c(c).cast("decimal(18,2)")


def ratio(num, den, on_zero: float | None = None) -> Column:
    """``num / den`` as DOUBLE; a zero denominator gives ``on_zero`` (NULL by default).

    A NULL operand gives NULL, as in SQL.
    """
    n, d = to_double(num), to_double(den)
    zero = F.lit(None).cast("double") if on_zero is None else F.lit(float(on_zero))
    return F.when(d == 0, zero).otherwise(n / d)


def period_key(ts, fmt: str = MONTH) -> Column:
    """String period key such as ``2012-03`` or ``2012-03-01`` (a literal suffix)."""
    return F.date_format(_c(ts), fmt)


def month_name(ts) -> Column:
    """Full English month name (``March``); Spark's ``monthname`` gives ``Mar``."""
    return F.date_format(_c(ts), "MMMM")


def flag(cond: Column) -> Column:
    """1 when the condition holds, else 0 (a NULL condition counts as 0, like CASE)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def half_even(c, scale: int = 0) -> Column:
    return F.bround(_c(c), scale)


def half_even_pct(part, whole, scale: int = 1) -> Column:
    """``round_half_even(part / whole * 100, scale)`` computed exactly in integers.

    Floating point would decide ties like 20.15 differently per engine; here the rational
    value is rounded, so every engine agrees. NULL when ``whole`` is 0.
    """
    unit = 10 ** scale
    num = _c(part).cast("decimal(38,0)") * F.lit(100 * unit)
    den = _c(whole).cast("decimal(38,0)")
    den = F.when(den == 0, F.lit(None)).otherwise(den)  # ANSI mode: no pmod by zero
    r = F.pmod(num, den)
    q = F.floor((num - r) / den)  # exact: num - r is a multiple of den
    q = (F.when(r * 2 > den, q + 1)
         .when((r * 2 == den) & (q % 2 == 1), q + 1)
         .otherwise(q))
    return q.cast("double") / F.lit(float(unit))
