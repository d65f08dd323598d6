"""Operators over the rows of a symbol, in date order. "Missing" is null or NaN; a window of d holds d calendar rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.operators.registry import operator
from tessera.plans.compiler import Frame
from tessera.plans.expr import DATE, FRAME, SYMBOL, Expr, cell, window


def _double(x: Expr) -> Expr:
    return cell("double", lambda a: a.cast("double"), x)


def _series(name: str, fn, *args, params: tuple = ()) -> Expr:
    return window(name, SYMBOL, fn, *args, params=params)


_ROLLED = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "var_pop": F.var_pop}


def rolled(how: str, x: Expr, d: int) -> Expr:
    """An aggregate of a window, as a node of its own: formulas that use it more than once, or together, share its column."""
    return _series(f"rolled_{how}", lambda f, a: _ROLLED[how](a).over(f.rows(d)), x, params=(d,))


def rolled_covariance(x: Expr, y: Expr, d: int) -> Expr:
    return _series("rolled_covar", lambda f, a, b: F.covar_pop(a, b).over(f.rows(d)), x, y, params=(d,))


def held(x: Expr) -> Expr:
    """x as a column: for what a formula names many times."""
    return window("held", FRAME, lambda df, name, a: df.withColumn(name, a), x)


def valid(x: Expr) -> Expr:
    return cell("valid", lambda a: M.valid(a.cast("double")), x)


@operator
def ts_mean(x: Expr, d: int) -> Expr:
    """Mean of the values that are not null; a NaN makes its windows NaN."""
    return rolled("avg", x, d)


@operator
def ts_sum(x: Expr, d: int) -> Expr:
    return rolled("sum", x, d)


@operator
def ts_std(x: Expr, d: int) -> Expr:
    """Population deviation; null under two values."""
    return cell("ts_std", lambda n, std: F.when(n >= 2, std), rolled("count", x, d), rolled("stddev_pop", x, d))


@operator
def ts_min(x: Expr, d: int) -> Expr:
    return rolled("min", x, d)


@operator
def ts_max(x: Expr, d: int) -> Expr:
    return rolled("max", x, d)


@operator
def ts_delay(x: Expr, d: int) -> Expr:
    """The value d rows before; of negative d, after."""
    return _series("ts_delay", lambda f, a: F.lag(a, d).over(f.series) if d >= 0 else F.lead(a, -d).over(f.series), x, params=(d,))


@operator
def ts_delta(x: Expr, d: int = 1) -> Expr:
    return x - ts_delay(x, d)


@operator
def kth_element(x: Expr, d: int, k: int) -> Expr:
    """The value k rows before; d changes nothing."""
    return ts_delay(x, k)


@operator
def ts_product(x: Expr, d: int) -> Expr:
    """NaN if any value is missing, 0 if any is 0, else by the sum of logarithms."""

    x = _double(x)
    bad = rolled("sum", cell("is_missing", lambda a: (~M.ok(a)).cast("long"), x), d)
    zeros = rolled("sum", cell("is_zero", lambda a: (a == 0).cast("long"), x), d)
    negative = rolled("sum", cell("is_negative", lambda a: (a < 0).cast("long"), x), d)
    logs = rolled("sum", cell("log_size", lambda a: F.when(M.ok(a) & (a != 0), F.ln(F.abs(a))), x), d)
    return cell("ts_product", lambda b, z, n, s: F.when(b > 0, M.nan()).when(z > 0, 0.0).otherwise(F.exp(s) * F.when(n % 2 == 1, -1.0).otherwise(1.0)), bad, zeros, negative, logs)


@operator
def ts_count_nans(x: Expr, d: int) -> Expr:
    """Nulls in the window; NaN does not count."""
    return _series("ts_count_nans", lambda f, a: F.sum(a.isNull().cast("long")).over(f.rows(d)), x, params=(d,))


@operator
def ts_zscore(x: Expr, d: int) -> Expr:
    """(x - mean) / sample deviation; NaN where the deviation is 0."""

    x = _double(x)

    def fn(a: Column, n: Column, mean: Column, std: Column) -> Column:
        # of equal values the deviation is exactly 0: frames are read value by value
        return F.when((n >= 2) & a.isNotNull(), F.when(std == 0, M.nan()).otherwise(M.div(a - mean, std)))

    return cell("ts_zscore", fn, x, *(rolled(k, x, d) for k in ("count", "avg", "stddev_samp")))


@operator
def ts_scale(x: Expr, d: int, constant: float = 0) -> Expr:
    """(x - min) / (max - min) + constant; null under two values, NaN if all are equal."""

    x = _double(x)
    return cell("ts_scale", lambda a, n, lo, hi: F.when(n >= 2, M.div(a - lo, hi - lo)) + F.lit(float(constant)), x, *(rolled(k, x, d) for k in ("count", "min", "max")), params=(constant,))


@operator
def ts_av_diff(x: Expr, d: int) -> Expr:
    """x less its mean; null unless all d values are there."""
    return cell("ts_av_diff", lambda a, n, mean: F.when(n == d, a - mean), x, rolled("count", x, d), rolled("avg", x, d), params=(d,))


@operator
def ts_step(x: Expr) -> Expr:
    """1, 2, 3, ... whatever the values."""
    return cell("ts_step", lambda a, i: (i + 1).cast("long"), x, "date_idx")


def _extreme(name: str, x: Expr, d: int, pick) -> Expr:
    def fn(f: Frame, a: Column) -> Column:
        i = f.index
        return F.when((i + 1 >= d) & M.ok(a), pick(f, a, i)).otherwise(M.nan())

    return _series(name, fn, _double(x), params=(d,))


@operator
def ts_arg_max(x: Expr, d: int) -> Expr:
    """Rows since the maximum, the latest of equal ones; NaN in the first d - 1 rows and where x is missing."""
    return _extreme("ts_arg_max", x, d, lambda f, a, i: (i - F.max(F.when(M.ok(a), F.struct(a.alias("x"), i.alias("i")))).over(f.rows(d))["i"]).cast("double"))


@operator
def ts_arg_min(x: Expr, d: int) -> Expr:
    return _extreme("ts_arg_min", x, d, lambda f, a, i: (i + F.min(F.when(M.ok(a), F.struct(a.alias("x"), (-i).alias("i")))).over(f.rows(d))["i"]).cast("double"))


@operator
def ts_backfill(x: Expr, d: int) -> Expr:
    """Fills at most d nulls in a row with the value before them; NaN is a value."""
    return _series("ts_backfill", lambda f, a: F.last(a, ignorenulls=True).over(f.between(-d, 0)), x, params=(d,))


@operator
def last_diff_value(x: Expr, d: int) -> Expr:
    """The latest value of the d - 1 rows before that differs from x; NaN if there is none or x is missing.

    It is the value before the last change, so running windows find it, whatever d is."""
    x = _double(x)
    v = valid(x)
    earlier = lambda f, c: F.last(c, ignorenulls=True).over(f.between(Window.unboundedPreceding, -1))
    before = _series("valid_before", earlier, v)
    place = _series("valid_before_at", lambda f, c: earlier(f, F.when(c.isNotNull(), f.index)), v)
    change = cell("changed_from", lambda c, p, i: F.when(c != p, F.struct(p.alias("value"), i.alias("at"))), v, before, place)
    last = _series("last_change", lambda f, c: F.last(c, ignorenulls=True).over(f.so_far), change)
    return cell("last_diff_value", lambda a, c, i: M.or_nan(F.when(M.ok(a) & (c["at"] > i - d), c["value"])), x, last, "date_idx", params=(d,))


@operator
def days_from_last_change(x: Expr) -> Expr:
    """Rows since the value changed; nulls are equal to each other, a NaN is always a change."""
    changed = _series("changed", lambda f, a: (f.index == 0) | ~a.eqNullSafe(F.lag(a).over(f.series)) | F.coalesce(F.isnan(a), F.lit(False)), _double(x))
    return _series("days_from_last_change", lambda f, c: (f.index - F.last(F.when(c, f.index), ignorenulls=True).over(f.so_far)).cast("long"), changed)


@operator
def ts_decay_linear(x: Expr, d: int, dense: bool = False) -> Expr:
    """Mean with weights 1 to d, the newest heaviest. A missing value makes it NaN; if dense, nulls are skipped and the
    weights of the others count, over full windows."""

    x = _double(x) if dense else valid(x)
    placed = cell("placed", lambda a, i: a * i, x, "date_idx")
    total = cell("decay_total", lambda i, s, t: s - (i - d) * t, "date_idx", rolled("sum", placed, d), rolled("sum", x, d), params=(d,))
    if dense:
        places = rolled("sum", cell("place", lambda a, i: F.when(a.isNotNull(), i), x, "date_idx"), d)
        # a row's weight is its index less that of the row before the window
        return cell("ts_decay_dense", lambda i, n, t, p: F.when((i + 1 >= d) & (n > 0), F.try_divide(t, (p - (i - d) * n).cast("double"))), "date_idx", rolled("count", x, d), total, places, params=(d,))
    return cell("ts_decay_linear", lambda n, t: F.when(n == d, t / (d * (d + 1) / 2)).otherwise(M.nan()), rolled("count", x, d), total, params=(d,))


def _less(x: Expr, d: int) -> tuple[Expr, Expr, Expr]:
    """(x, values of the window below it, values there), each a column: what is made of them names them often."""
    x = _double(x)
    seen = _series("rolled_values", lambda f, a: F.collect_list(M.valid(a)).over(f.rows(d)), x, params=(d,))
    less = held(cell("rolled_less", lambda a, v: F.size(F.filter(v, lambda e: e < a)), x, seen))
    return x, less, rolled("count", valid(x), d)


@operator
def ts_rank(x: Expr, d: int, constant: float = 0) -> Expr:
    """constant + share of the other values that are smaller; 0.5 if alone, NaN where x is missing."""

    def fn(a: Column, less: Column, n: Column) -> Column:
        return F.when(~M.ok(a), M.nan()).when(n == 1, F.lit(0.5 + constant)).otherwise(F.lit(float(constant)) + F.try_divide(less.cast("double"), (n - 1).cast("double")))

    return cell("ts_rank", fn, *_less(x, d), params=(constant,))


@operator
def ts_quantile(x: Expr, d: int, driver: str = "gaussian") -> Expr:
    """The share of smaller values, moved to the open interval, through the inverse normal (or, of any other driver, to -1
    to 1); 0 if alone, NaN where x is missing."""

    x, less, n = _less(x, d)
    p = held(cell("share_below", lambda k, n: F.try_divide(k + 0.5, n.cast("double")), less, n))

    def fn(a: Column, n: Column, p: Column) -> Column:
        return F.when(~M.ok(a), M.nan()).when(n == 1, 0.0).otherwise(M.inverse_normal(p) if driver == "gaussian" else 2 * p - 1)

    return cell("ts_quantile", fn, x, n, p, params=(driver,))


def _pairs(x: Expr, y: Expr) -> tuple[Expr, Expr]:
    """Both operands, null where either is missing."""
    x, y = _double(x), _double(y)
    both = lambda a, b: F.when(M.ok(a) & M.ok(b), a)
    return cell("both", both, x, y), cell("both", both, y, x)


@operator
def ts_covariance(x: Expr, y: Expr, d: int) -> Expr:
    """Population covariance; NaN unless all d pairs are there."""
    a, b = _pairs(x, y)
    return cell("ts_covariance", lambda n, c: F.when(n == d, c).otherwise(M.nan()), rolled("count", a, d), rolled_covariance(a, b, d), params=(d,))


@operator
def ts_corr(x: Expr, y: Expr, d: int) -> Expr:
    """Correlation; NaN unless all d pairs are there and both vary."""
    a, b = _pairs(x, y)

    fn = lambda n, c, sa, sb: M.or_nan(F.when(n == d, F.try_divide(c, sa * sb)))
    return cell("ts_corr", fn, rolled("count", a, d), rolled_covariance(a, b, d), rolled("stddev_pop", a, d), rolled("stddev_pop", b, d), params=(d,))


#: Names for what ts_regression returns.
REGRESSION = {
    "resid": 0, "residual": 0,
    "beta": 1, "slope": 1,
    "alpha": 2, "intercept": 2,
    "predicted": 3, "pred": 3,
    "corr": 4, "correlation": 4,
    "r_squared": 5, "rsquared": 5, "r2": 5,
    "tstat_beta": 6,
    "tstat_alpha": 7,
    "stderr_beta": 8,
    "stderr_alpha": 9,
}


@operator
def ts_regression(y: Expr, x: Expr, d: int, lag: int = 0, rettype: int | str = 0) -> Expr:
    """Least squares of y on x lagged by lag rows; NaN unless all d pairs are there and x varies. rettype: 0 residual, 1 beta,
    2 alpha, 3 predicted, 4 correlation, 5 its square, 6 and 7 t of beta and alpha, 8 and 9 their standard errors."""
    kind = REGRESSION.get(rettype.lower(), 0) if isinstance(rettype, str) else int(rettype)
    a, b = _pairs(ts_delay(x, lag) if lag else x, y)

    def fn(a, b, n, mx, my, vx, vy, c):
        # a: x, b: y; a variance of equal values is exactly 0
        sxx, syy, sxy = F.when(vx > 0, vx * d), F.when(vy > 0, vy * d), c * d
        beta = F.try_divide(sxy, sxx)
        alpha = my - beta * mx
        corr = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
        rest = F.coalesce(syy, F.lit(0.0)) - beta * sxy
        var = F.when(rest > 0, rest / (d - 2)) if d > 2 else F.lit(None).cast("double")
        se_beta = F.sqrt(F.try_divide(var, sxx))
        se_alpha = F.sqrt(var * (F.lit(1.0 / d) + F.try_divide(mx * mx, sxx)))
        out = [b - (alpha + beta * a), beta, alpha, alpha + beta * a, corr, corr * corr, F.try_divide(beta, se_beta), F.try_divide(alpha, se_alpha), se_beta, se_alpha]
        return M.or_nan(F.when(n == d, out[kind])) if 0 <= kind <= 9 else M.nan()

    sums = (rolled("count", a, d), rolled("avg", a, d), rolled("avg", b, d), rolled("var_pop", a, d), rolled("var_pop", b, d), rolled_covariance(a, b, d))
    return cell("ts_regression", fn, a, b, *sums, params=(d, kind))


@operator
def hump(x: Expr, hump_factor: float = 0.01) -> Expr:
    """Follows x by steps of at most hump_factor times the date's sum of absolute values; passes x through where it or the
    value before is missing. A recursion along each symbol: rows are dealt by symbol, sorted and read as a stream, and
    one value per symbol is held."""
    x = _double(x)
    limit = window("hump_limit", DATE, lambda f, a: F.coalesce(F.sum(F.abs(M.valid(a))).over(f.day), F.lit(0.0)) * hump_factor, x, params=(hump_factor,))

    def fn(df: DataFrame, name: str, a: Column, most: Column) -> DataFrame:
        df = df.withColumns({"_hump_x": a, "_hump_limit": most})
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in ("_hump_x", "_hump_limit")) + f", `{name}` double"
        return df.repartition("symbol").sortWithinPartitions("symbol", "date_idx").mapInArrow(_follow(name), schema)

    return window("hump", FRAME, fn, x, limit, params=(hump_factor,))


def _follow(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, now = object(), math.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("symbol").dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            # a null is a NaN here: both pass through, as NaN
            xs, limits = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_hump_x", "_hump_limit"))
            out = []
            for lo, hi in zip(starts, starts[1:], strict=False):
                s = codes.dictionary[int(code[lo])].as_py()
                if s != symbol:
                    symbol, now = s, math.nan
                for x, most in zip(xs[lo:hi], limits[lo:hi], strict=True):
                    if x != x or now != now:
                        now = x
                    else:
                        step = x - now
                        # an infinite step less itself is NaN, and so passes as it is
                        now = x if -most <= step <= most else now + most if step > 0 else now - most if step < 0 else math.nan
                    out.append(now)
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_hump_x", "_hump_limit")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.float64())], names=[*(batch.schema.names[i] for i in keep), name])

    return run
