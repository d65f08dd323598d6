"""The intermediate form of formulas: hash-consed nodes, and expressions with overloaded operators on top.

A node is a field, a literal, a cell (a narrow projection of its arguments) or a windowed node, which needs its
arguments as columns and is evaluated over one of three partitionings: by symbol, by date, or by date and group. Equal
nodes are one object, so a shared sub-expression is one column of the plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import mathx as M

#: Ways to partition a windowed node; FRAME nodes transform the whole table.
SYMBOL, DATE, GROUP, FRAME = "symbol", "date", "group", "frame"


class Node:
    """Do not make nodes directly: field(), literal(), cell() and window() return the one node of equal content."""

    _known: dict[tuple, Node] = {}
    __slots__ = ("args", "fn", "kind", "level", "name", "params", "part")

    def __init__(self, kind: str, name: str, args: tuple[Node, ...], params: tuple, fn: Callable | None, part: str | None):
        self.kind, self.name, self.args, self.params, self.fn, self.part = kind, name, args, params, fn, part
        below = max((a.level for a in args), default=0)
        self.level = below + 1 if kind == "window" else below

    @classmethod
    def of(cls, kind: str, name: str, args: tuple[Node, ...] = (), params: tuple = (), fn: Callable | None = None, part: str | None = None) -> Node:
        key = (kind, name, tuple(map(id, args)), tuple((type(p), p) for p in params), part)
        if key not in cls._known:
            cls._known[key] = cls(kind, name, args, params, fn, part)
        return cls._known[key]

    def walk(self, seen: set[int] | None = None):
        """All nodes below and this one, arguments first, each once."""
        seen = set() if seen is None else seen
        if id(self) in seen:
            return
        seen.add(id(self))
        for a in self.args:
            yield from a.walk(seen)
        yield self


def node(x: Any) -> Node:
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, Node):
        return x
    if isinstance(x, bool):
        return Node.of("literal", "literal", params=(x,))
    if isinstance(x, (int, float)):
        return Node.of("literal", "literal", params=(repr(x), x) if x != x else (x,))
    if isinstance(x, str):
        return Node.of("field", x)
    raise TypeError(f"cannot use {type(x).__name__} in a formula")


def cell(name: str, fn: Callable[..., Column], *args: Any, params: tuple = ()) -> Expr:
    """A narrow node: fn gets the columns of args."""
    return Expr(Node.of("cell", name, tuple(map(node, args)), params, fn))


def window(name: str, part: str, fn: Callable[..., Column], *args: Any, params: tuple = ()) -> Expr:
    """A windowed node: fn gets a Frame and the columns of args."""
    return Expr(Node.of("window", name, tuple(map(node, args)), params, fn, part))


def field(name: str) -> Expr:
    return Expr(Node.of("field", name))


def _number(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(a, b).cast("double")


def _power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def _logic(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    as_bool = lambda x: x.cast("double") != 0
    return lambda a, b: f(as_bool(a), as_bool(b)).cast("double")


class Expr:
    """An operand of formulas. Arithmetic is IEEE; comparisons and logic give 0.0 or 1.0, null where an operand is."""

    __slots__ = ("node",)

    def __init__(self, n: Node):
        self.node = n

    def _with(self, other: Any, name: str, fn: Callable, swap: bool = False) -> Expr:
        if not isinstance(other, (Expr, int, float)):
            return NotImplemented
        return cell(name, fn, other, self) if swap else cell(name, fn, self, other)

    def __add__(self, o):
        return self._with(o, "add", lambda a, b: a + b)

    def __radd__(self, o):
        return self._with(o, "add", lambda a, b: a + b, True)

    def __sub__(self, o):
        return self._with(o, "sub", lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, "sub", lambda a, b: a - b, True)

    def __mul__(self, o):
        return self._with(o, "mul", lambda a, b: a * b)

    def __rmul__(self, o):
        return self._with(o, "mul", lambda a, b: a * b, True)

    def __truediv__(self, o):
        return self._with(o, "div", M.div)

    def __rtruediv__(self, o):
        return self._with(o, "div", M.div, True)

    def __pow__(self, o):
        return self._with(o, "pow", _power)

    def __rpow__(self, o):
        return self._with(o, "pow", _power, True)

    def __neg__(self):
        return cell("neg", lambda a: -a, self)

    def __pos__(self):
        return self

    def __abs__(self):
        return cell("abs", F.abs, self)

    def __lt__(self, o):
        return self._with(o, "lt01", _number(lambda a, b: a < b))

    def __le__(self, o):
        return self._with(o, "le01", _number(lambda a, b: a <= b))

    def __gt__(self, o):
        return self._with(o, "gt01", _number(lambda a, b: a > b))

    def __ge__(self, o):
        return self._with(o, "ge01", _number(lambda a, b: a >= b))

    def __eq__(self, o):
        return self._with(o, "eq01", _number(lambda a, b: a == b))

    def __ne__(self, o):
        return self._with(o, "ne01", _number(lambda a, b: a != b))

    def _both(self, o, name, fn):
        if not isinstance(o, Expr):
            raise ValueError("logical operators take two expressions")
        return cell(name, _logic(fn), self, o)

    def __and__(self, o):
        return self._both(o, "and01", lambda a, b: a & b)

    def __or__(self, o):
        return self._both(o, "or01", lambda a, b: a | b)

    def __rand__(self, o):
        return self._both(o, "and01", lambda a, b: a & b)

    def __ror__(self, o):
        return self._both(o, "or01", lambda a, b: a | b)

    def __invert__(self):
        return cell("not01", lambda a: F.when(a == 0, 1.0).otherwise(0.0), self)

    def __bool__(self):
        raise TypeError("a formula has no truth value; use & | ~")

    def __hash__(self):
        return id(self.node)
