"""From nodes to a plan: level by level, one select for each partitioning of a level.

A level holds the windowed nodes whose arguments are ready; cells between them are inlined where they are used, or made a
column where a window needs them. Within a level, nodes of the partitioning that rows have already come first, so the
plan changes partitioning (one exchange and sort) as seldom as it can."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.plans.errors import ExpressionError
from tessera.plans.expr import DATE, FRAME, GROUP, SYMBOL, Node
from tessera.plans.panel import INDEX, Panel


@dataclass(frozen=True)
class Frame:
    """What a windowed node may use: partitionings, and the columns that order them."""

    group: Column | None = None
    #: What ties go by: the symbol, or its place among the columns of a matrix.
    tie: str = "symbol"

    index = property(lambda self: F.col(INDEX))
    symbol = property(lambda self: F.col("symbol"))

    @property
    def series(self) -> WindowSpec:
        """The rows of a symbol in date order."""
        return Window.partitionBy("symbol").orderBy(INDEX)

    def rows(self, d: int) -> WindowSpec:
        """The last d rows of a symbol, this one included."""
        return self.series.rowsBetween(-(d - 1), 0)

    def between(self, lo: int, hi: int) -> WindowSpec:
        return self.series.rowsBetween(lo, hi)

    @property
    def so_far(self) -> WindowSpec:
        return self.series.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def day(self) -> WindowSpec:
        """All rows of a date, or of a date and group."""
        return Window.partitionBy(INDEX) if self.group is None else Window.partitionBy(INDEX, self.group)

    def ordered(self, *by: Column) -> WindowSpec:
        return self.day.orderBy(*by, self.tie)


def _column(n: Node, made: dict[int, str], fields: set[str]) -> Column:
    if id(n) in made:
        return F.col(made[id(n)])
    if n.kind == "literal":
        return F.lit(n.params[-1])
    if n.kind == "field":
        if n.name not in fields:
            raise ExpressionError(f"unknown field: {n.name}")
        return F.col(f"`{n.name}`")
    return n.fn(*(_column(a, made, fields) for a in n.args))


def compile_nodes(panel: Panel, named: dict[str, Node]) -> DataFrame:
    """date, date_idx, symbol and a column for each of named."""
    fields = set(panel.df.columns)
    roots = list(named.values())
    seen: set[int] = set()
    nodes = [n for r in roots for n in r.walk(seen)]
    used = {n.name for n in nodes if n.kind == "field"}
    if missing := sorted(used - fields):
        raise ExpressionError(f"unknown field: {', '.join(missing)}")
    order = [c for c in ("symbol_pos",) if c in fields]
    df = panel.df.select("date", INDEX, "symbol", *order, *sorted(used - {"date", INDEX, "symbol", *order}))
    tie = order[0] if order else "symbol"
    made: dict[int, str] = {}
    now = None
    for level in range(1, max((n.level for n in nodes), default=0) + 1):
        todo = [n for n in nodes if n.kind == "window" and n.level == level]
        # arguments that are not columns yet
        ready = {}
        for n in todo:
            for a in n.args:
                if a.kind == "cell" and id(a) not in made:
                    ready[f"_c{len(made) + len(ready)}"] = a
        if ready:
            df = df.withColumns({k: _column(a, made, fields) for k, a in ready.items()})
            made |= {id(a): k for k, a in ready.items()}
        parts = sorted({n.part for n in todo}, key=lambda p: (p != now, p))
        for part in parts:
            columns = {}
            for n in (x for x in todo if x.part == part):
                args = [_column(a, made, fields) for a in n.args]
                name = f"_w{len(made) + len(columns)}"
                if part == FRAME:
                    df = n.fn(df, name, *args)
                    made[id(n)] = name
                elif part == GROUP:
                    columns[name] = (n, n.fn(Frame(args[-1], tie), *args[:-1]))
                else:
                    columns[name] = (n, n.fn(Frame(tie=tie), *args))
            if columns:
                df = df.withColumns({k: c for k, (_, c) in columns.items()})
                made |= {id(n): k for k, (n, _) in columns.items()}
            now = part
    return df.select("date", INDEX, "symbol", *(_column(n, made, fields).alias(k) for k, n in named.items()))


__all__ = ["DATE", "FRAME", "GROUP", "SYMBOL", "Frame", "compile_nodes"]
