"""Operators over the symbols of a date. Missing values take no part and give NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.operators.registry import operator
from tessera.operators.time_series import _double, held, valid
from tessera.plans.expr import DATE, GROUP, Expr, cell, window


def _day(name: str, fn, *args, params: tuple = ()) -> Expr:
    return window(name, DATE, fn, *args, params=params)


_OF_DAY = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_pop": F.stddev_pop}


def of_day(how: str, x: Expr, group: Expr | None = None) -> Expr:
    """An aggregate over a date (and group), as a node of its own, shared by what names it."""
    fn = lambda f, a: _OF_DAY[how](a).over(f.day)
    return window(f"day_{how}", DATE, fn, x) if group is None else window(f"group_{how}", GROUP, fn, x, group)


def place(x: Expr, group: Expr | None = None) -> Expr:
    """Place from 0 among the values of a date (and group) that are there; ties in order of symbol."""
    fn = lambda f, a: F.row_number().over(f.ordered(M.ok(a).desc(), a)) - 1
    return window("place", DATE, fn, x) if group is None else window("place", GROUP, fn, x, group)


def moments(x: Expr, group: Expr | None = None) -> tuple[Expr, Expr]:
    """(mean, population deviation), with a deviation of exactly 0 where all values are equal."""
    lo, hi = of_day("min", x, group), of_day("max", x, group)
    mean = cell("day_mean", lambda a, b, m: F.when(a == b, a).otherwise(m), lo, hi, of_day("avg", x, group))
    return mean, cell("day_dev", lambda a, b, s: F.when(a == b, 0.0).otherwise(s), lo, hi, of_day("stddev_pop", x, group))


@operator
def rank(x: Expr, rate: int = 2) -> Expr:
    """Place / (n - 1); 0 if alone. rate is accepted: ranks are always exact, whatever it says."""
    x = _double(x)
    fn = lambda a, k, n: F.when(~M.ok(a), M.nan()).when(n == 1, 0.0).otherwise(F.try_divide(k.cast("double"), (n - 1).cast("double")))
    return cell("rank", fn, x, place(x), of_day("count", valid(x)))


@operator
def zscore(x: Expr) -> Expr:
    """(x - mean) / population deviation; NaN where that is 0."""
    v = valid(x)
    return cell("zscore", lambda a, m, s: M.or_nan(F.when(s > 0, F.try_divide(a - m, s))), v, *moments(v))


@operator
def scale(x: Expr, scale_factor: float = 1.0, longscale: float = 0.0, shortscale: float = 0.0) -> Expr:
    """x / sum of |x| * scale_factor; with longscale or shortscale, positive and negative values are scaled apart and all else is 0."""
    v = valid(x)
    if longscale > 0 or shortscale > 0:
        up = of_day("sum", cell("above", lambda a: F.when(a > 0, a), v))
        down = of_day("sum", cell("below", lambda a: F.when(a < 0, -a), v))
        fn = lambda a, u, d: F.when((a > 0) & F.lit(longscale > 0), a / u * float(longscale)).when((a < 0) & F.lit(shortscale > 0), a / d * float(shortscale)).otherwise(0.0)
        return cell("scale_sides", fn, v, up, down, params=(longscale, shortscale))
    return cell("scale", lambda a, s: M.or_nan(F.try_divide(a * float(scale_factor), s)), v, of_day("sum", cell("size", F.abs, v)), params=(scale_factor,))


@operator
def normalize(x: Expr, useStd: bool = False, limit: float = 0.0) -> Expr:  # noqa: N803
    """x less the mean, by choice over the population deviation, cut to plus and minus limit if that is positive."""
    v = valid(x)

    def fn(a: Column, mean: Column, std: Column) -> Column:
        out = a - mean
        if useStd:
            out = F.when(std > 0, F.try_divide(out, std))
        if limit > 0:
            out = M.clip(out, F.lit(-float(limit)), F.lit(float(limit)))
        return M.or_nan(out)

    return cell("normalize", fn, v, *moments(v), params=(bool(useStd), limit))


@operator
def quantile(x: Expr, driver: str = "gaussian", sigma: float = 1.0) -> Expr:
    """The rank, moved into the open interval, through a distribution's inverse: gaussian, uniform or cauchy; 0 if alone."""
    if driver not in ("gaussian", "uniform", "cauchy"):
        raise ValueError(f"unknown driver: {driver}")
    x = _double(x)

    def inside(k: Column, n: Column) -> Column:
        n1 = n.cast("double")
        return F.try_divide(F.lit(1.0), n1) + F.try_divide(k.cast("double"), n1 - 1) * (1 - F.try_divide(F.lit(2.0), n1))

    def fn(a: Column, n: Column, p: Column) -> Column:
        out = {"gaussian": lambda: M.inverse_normal(p), "uniform": lambda: 2 * (p - 0.5), "cauchy": lambda: F.tan(math.pi * (p - 0.5))}[driver]()
        return F.when(~M.ok(a), M.nan()).when(n <= 1, 0.0).otherwise(out * float(sigma))

    n = of_day("count", valid(x))
    return cell("quantile", fn, x, n, held(cell("share_inside", inside, place(x), n)), params=(driver, sigma))


@operator
def winsorize(x: Expr, std: float = 4.0) -> Expr:
    """x cut to the mean plus and minus std population deviations."""
    v = valid(x)
    return cell("winsorize", lambda a, m, s: M.or_nan(M.clip(a, m - s * float(std), m + s * float(std))), v, *moments(v), params=(std,))


@operator
def bucket(x: Expr, range_spec: str) -> Expr:
    """The lower edge of x's bucket; range_spec: "start,end,step", edges from start to end - step."""
    parts = [float(p) for p in str(range_spec).split(",")]
    if len(parts) != 3:
        raise ValueError("range_spec needs start, end and step")
    start, end, step = parts
    if step <= 0:
        raise ValueError("step must be positive")

    def fn(a: Column) -> Column:
        edge = F.floor((a - start) / step) * step + start
        return F.when(~M.ok(a), M.nan()).otherwise(M.clip(edge, F.lit(start), F.lit(end - step)))

    return cell("bucket", fn, _double(x), params=(start, end, step))


@operator
def densify(x: Expr) -> Expr:
    """Dense codes 0, 1, ... of a date's distinct values, smallest first; NaN where x is missing."""
    return _day("densify", lambda f, a: F.when(M.ok(a), (F.dense_rank().over(f.day.orderBy(M.ok(a).desc(), a)) - 1).cast("double")).otherwise(M.nan()), _double(x))
