"""Operators over the symbols of a date that share a label. A null label gives NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.operators.cross_section import moments, of_day, place
from tessera.operators.registry import operator
from tessera.operators.time_series import _double, valid
from tessera.plans.expr import FRAME, Expr, cell, window


def _grouped(name: str, fn, *args: Expr, group: Expr, params: tuple = ()) -> Expr:
    """fn of columns, NaN where it is null or the label is."""
    return cell(name, lambda g, *a: F.when(g.isNull(), M.nan()).otherwise(M.or_nan(fn(*a))), group, *args, params=params)


@operator
def group_neutralize(x: Expr, group: Expr) -> Expr:
    """x less its group's mean."""
    v = valid(x)
    return _grouped("group_neutralize", lambda a, m: a - m, v, of_day("avg", v, group), group=group)


@operator
def group_zscore(x: Expr, group: Expr) -> Expr:
    """(x - mean) / population deviation within the group; NaN where that is 0."""
    v = valid(x)
    return _grouped("group_zscore", lambda a, m, s: F.when(s > 0, F.try_divide(a - m, s)), v, *moments(v, group), group=group)


@operator
def group_scale(x: Expr, group: Expr) -> Expr:
    """x to 0 to 1 by the group's extremes; NaN where they are equal."""
    v = valid(x)
    return _grouped("group_scale", lambda a, lo, hi: F.try_divide(a - lo, hi - lo), v, of_day("min", v, group), of_day("max", v, group), group=group)


@operator
def group_rank(x: Expr, group: Expr) -> Expr:
    """Place / (n - 1) within the group; 0.5 if alone."""
    x = _double(x)
    fn = lambda a, k, n: F.when(~M.ok(a), M.nan()).when(n == 1, 0.5).otherwise(F.try_divide(k.cast("double"), (n - 1).cast("double")))
    return _grouped("group_rank", fn, x, place(x, group), of_day("count", valid(x), group), group=group)


@operator
def group_mean(x: Expr, weight: Expr | int | float, group: Expr) -> Expr:
    """The group's weighted mean over members with both, for every member; NaN unless the weights sum to more than 0."""
    both = lambda f: lambda a, w: F.when(M.ok(a) & M.ok(w), f(a, w))
    x, w = _double(x), _double(weight)
    top, total = cell("weighted", both(lambda a, w: a * w), x, w), cell("weight", both(lambda a, w: w), x, w)
    return _grouped("group_mean", lambda t, n: F.when(n > 0, F.try_divide(t, n)), of_day("sum", top, group), of_day("sum", total, group), group=group)


@operator
def group_backfill(x: Expr, group: Expr, d: int, std: float = 4.0) -> Expr:
    """Missing values become the mean of the group's values of the last d dates, cut to mean plus and minus std deviations;
    null if there is none.

    Bounds come from moments of each group and date, a row each. The cut mean is the mean less what lies beyond the bounds:
    only values that are beyond those of some window are brought to its dates, and summed in part before they move, so
    no group is gathered."""

    def fn(df: DataFrame, name: str, a: Column, g: Column) -> DataFrame:
        rows = df.withColumns({"_gb_x": a, "_gb_g": g})
        x, key = F.col("_gb_x"), ["_gb_g", "date_idx"]
        v = M.valid(x)
        of_days = rows.filter("_gb_g IS NOT NULL").groupBy(*key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        dates = Window.partitionBy("_gb_g").orderBy("date_idx")
        last, ahead = dates.rangeBetween(-(d - 1), 0), dates.rangeBetween(0, d - 1)
        days = of_days.select(
            *key, F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean"))).over(last).alias("parts"), F.sum("n").over(last).cast("double").alias("n"),
            F.try_divide(F.sum(F.col("mean") * F.col("n")).over(last), F.sum("n").over(last).cast("double")).alias("mean"), F.sum(F.col("var") * F.col("n")).over(last).alias("within"), F.min("lo").over(last).alias("lo"), F.max("hi").over(last).alias("hi"),
        )
        mean = F.col("mean")
        # the spread within days and that of the days' means: few terms, and no difference of large squares
        between = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
        days = days.withColumn("var", F.try_divide(F.col("within") + between, F.col("n")))
        days = days.withColumns({"least": mean - F.sqrt("var") * float(std), "most": mean + F.sqrt("var") * float(std)})
        whole = (F.col("n") == 1) | (F.col("var") <= 0) | (F.col("lo") >= F.col("least")) & (F.col("hi") <= F.col("most"))
        days = days.select(*key, "n", "mean", "least", "most", F.coalesce(~whole, F.lit(False)).alias("bites"))
        bites = lambda c: F.when(F.col("bites"), F.col(c))
        # the narrowest bounds of the windows that a date's values are in
        narrow = days.select(*key, F.max(bites("least")).over(ahead).alias("_gb_low"), F.min(bites("most")).over(ahead).alias("_gb_high")).filter("_gb_low IS NOT NULL")
        far = rows.filter(M.ok(x)).select(*key, "_gb_x").join(narrow, key).filter((x < F.col("_gb_low")) | (x > F.col("_gb_high")))
        far = far.select("_gb_g", F.explode(F.sequence(F.col("date_idx"), F.col("date_idx") + (d - 1))).alias("date_idx"), "_gb_x")
        beyond = F.when(x > F.col("most"), x - F.col("most")).when(x < F.col("least"), x - F.col("least"))
        far = far.join(days.filter("bites").select(*key, "least", "most"), key).groupBy(*key).agg(F.sum(beyond).alias("_gb_far"))
        fill = mean - F.coalesce(F.try_divide(F.col("_gb_far"), F.col("n")), F.lit(0.0))
        days = days.join(far, key, "left").select(*key, fill.alias("_gb_fill"))
        out = rows.join(days, key, "left")
        return out.withColumn(name, F.when(M.ok(x), x).otherwise(F.col("_gb_fill"))).drop("_gb_x", "_gb_g", "_gb_fill")

    return window("group_backfill", FRAME, fn, _double(x), group, params=(d, std))
