"""Pure column expressions; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def nan() -> Column:
    return F.lit(NAN)


def ok(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def valid(x: Column) -> Column:
    """x, null where it is NaN."""
    return F.when(ok(x), x)


def or_nan(x: Column) -> Column:
    """x, NaN where it is null."""
    return F.coalesce(x, nan())


def div(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of an error; null if either is null."""
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def safe_div(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ieee_log(x: Column) -> Column:
    return F.when(x.isNull(), None).when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), nan()).otherwise(F.ln(x))


def ieee_sqrt(x: Column) -> Column:
    return F.when(x < 0, nan()).otherwise(F.sqrt(x))


#: Coefficients of a published rational approximation of the inverse normal distribution (P. J. Acklam).
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def _poly(x: Column, coefficients, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in (*coefficients[1:], *([] if last is None else [last])):
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The quantile of the standard normal distribution; infinities at 0 and 1."""
    q = p - 0.5
    r = q * q
    mid = _poly(r, A) * q / _poly(r, B, 1.0)
    lo = F.sqrt(-2 * F.ln(p))
    hi = F.sqrt(-2 * F.ln(1 - p))
    tail = lambda t: _poly(t, C) / _poly(t, D, 1.0)
    return F.when(p <= 0, F.lit(-INF)).when(p >= 1, F.lit(INF)).when(p < TAIL, tail(lo)).when(p <= 1 - TAIL, mid).otherwise(-tail(hi))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not (isinstance(x, float) and math.isnan(x))
