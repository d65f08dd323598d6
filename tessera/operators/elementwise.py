"""Narrow operators: arithmetic, comparison and logic, arrays, and the conditional carry-forward."""

from __future__ import annotations

import builtins
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.operators.registry import operator
from tessera.plans.compiler import Frame
from tessera.plans.expr import SYMBOL, Expr, cell, window

Operand = Expr | int | float


def _numbers(args) -> bool:
    return all(isinstance(a, (int, float)) for a in args)


@operator
def abs(x: Operand):  # noqa: A001
    return builtins.abs(x)


@operator
def add(*args: Operand, filter: bool = False):  # noqa: A002
    """Sum of two operands or more; with filter, a null counts as 0."""
    if len(args) < 2:
        raise ValueError("add needs two operands or more")
    if _numbers(args):
        return sum(args)
    none = (lambda a: F.coalesce(a, F.lit(0))) if filter else (lambda a: a)
    return cell("add_n", lambda *a: reduce(lambda p, q: p + q, map(none, a)), *args, params=(bool(filter),))


@operator
def subtract(x: Operand, y: Operand, filter: bool = False):  # noqa: A002
    none = (lambda a: F.coalesce(a, F.lit(0))) if filter else (lambda a: a)
    return x - y if _numbers((x, y)) else cell("subtract", lambda a, b: none(a) - none(b), x, y, params=(bool(filter),))


@operator
def multiply(*args: Operand, filter: bool = False):  # noqa: A002
    """Product of two operands or more; with filter, a null counts as 1."""
    if len(args) < 2:
        raise ValueError("multiply needs two operands or more")
    if _numbers(args):
        return reduce(lambda p, q: p * q, args)
    none = (lambda a: F.coalesce(a, F.lit(1))) if filter else (lambda a: a)
    return cell("multiply_n", lambda *a: reduce(lambda p, q: p * q, map(none, a)), *args, params=(bool(filter),))


@operator
def divide(x: Operand, y: Operand) -> Expr:
    """Null where y is 0."""
    return cell("divide", M.safe_div, x, y)


@operator
def inverse(x: Expr) -> Expr:
    return cell("inverse", lambda a: M.safe_div(F.lit(1.0), a), x)


@operator
def log(x: Expr) -> Expr:
    """Null unless x is positive."""
    return cell("log", lambda a: F.when(a > 0, F.ln(a)), x)


def _horizontal(name: str, fn, args):
    if not any(isinstance(a, Expr) for a in args):
        return {"max": builtins.max, "min": builtins.min}[name](*args)
    return cell(f"{name}_n", lambda *a: fn(*(c.cast("double") for c in a)) if len(a) > 1 else a[0], *args)


@operator
def max(*args):  # noqa: A001
    """The largest of the operands that are not null."""
    return _horizontal("max", F.greatest, args)


@operator
def min(*args):  # noqa: A001
    return _horizontal("min", F.least, args)


@operator
def power(x: Operand, y: Operand):
    return x**y


@operator
def signed_power(x: Expr, y: Operand) -> Expr:
    return cell("signed_power", lambda a, b: F.signum(a) * F.pow(F.abs(a).cast("double"), b.cast("double")), x, y)


@operator
def sqrt(x: Expr) -> Expr:
    """Null where x is negative."""
    return cell("sqrt", lambda a: F.when(a >= 0, F.sqrt(a)), x)


@operator
def sign(x: Expr) -> Expr:
    return cell("sign", F.signum, x)


@operator
def reverse(x: Expr) -> Expr:
    return -x


def _truth(a: Column) -> Column:
    return a.cast("boolean")


@operator
def and_(x: Operand, y: Operand) -> Expr:
    return cell("and_", lambda a, b: _truth(a) & _truth(b), x, y)


@operator
def or_(x: Operand, y: Operand) -> Expr:
    return cell("or_", lambda a, b: _truth(a) | _truth(b), x, y)


@operator
def not_(x: Expr) -> Expr:
    return cell("not_", lambda a: ~_truth(a), x)


@operator
def if_else(cond: Expr, then_: Operand, else_: Operand) -> Expr:
    """else_ where cond is null."""
    return cell("if_else", lambda c, a, b: F.when(_truth(c), a).otherwise(b), cond, then_, else_)


@operator
def is_nan(x: Expr) -> Expr:
    """True where x is null or NaN."""
    return cell("is_nan", lambda a: a.isNull() | F.isnan(a.cast("double")), x)


@operator
def lt(x: Operand, y: Operand) -> Expr:
    return cell("lt", lambda a, b: a < b, x, y)


@operator
def le(x: Operand, y: Operand) -> Expr:
    return cell("le", lambda a, b: a <= b, x, y)


@operator
def gt(x: Operand, y: Operand) -> Expr:
    return cell("gt", lambda a, b: a > b, x, y)


@operator
def ge(x: Operand, y: Operand) -> Expr:
    return cell("ge", lambda a, b: a >= b, x, y)


@operator
def eq(x: Operand, y: Operand) -> Expr:
    return cell("eq", lambda a, b: a == b, x, y)


@operator
def ne(x: Operand, y: Operand) -> Expr:
    return cell("ne", lambda a, b: a != b, x, y)


@operator
def vec_avg(x: Expr) -> Expr:
    """Mean of an array's elements that are not null; null of an empty one."""

    def fn(a: Column) -> Column:
        v = F.filter(a, lambda e: e.isNotNull())
        return F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double")), F.size(v).cast("double"))

    return cell("vec_avg", fn, x)


@operator
def vec_sum(x: Expr) -> Expr:
    """Sum of an array's elements that are not null; 0 of an empty one."""
    return cell("vec_sum", lambda a: F.aggregate(F.filter(a, lambda e: e.isNotNull()), F.lit(0.0), lambda s, e: s + e.cast("double")), x)


@operator
def trade_when(trigger_trade: Operand, alpha: Operand, trigger_exit: Operand) -> Expr:
    """alpha where trigger_trade is positive, carried forward until trigger_exit is, which comes first and gives NaN."""

    def fn(f: Frame, trade: Column, a: Column, leave: Column) -> Column:
        up = lambda c: (c.cast("double") > 0) & ~F.isnan(c.cast("double"))
        event = F.when(up(leave), F.struct(F.lit(None).cast("double").alias("v"))).when(up(trade), F.struct(a.cast("double").alias("v")))
        return M.or_nan(F.last(event, ignorenulls=True).over(f.so_far)["v"])

    return window("trade_when", SYMBOL, fn, trigger_trade, alpha, trigger_exit)
