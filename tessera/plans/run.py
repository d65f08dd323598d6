"""Evaluating formulas over a panel."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.compiler import compile_nodes
from tessera.plans.errors import ExpressionError
from tessera.plans.expr import Expr, node
from tessera.plans.language import parse
from tessera.plans.panel import INDEX, Panel


def compute(formula: str | Expr, panel: Panel | None = None, lookback: Panel | None = None, name: str = "value", ops: Any = None, **fields: Any) -> DataFrame:
    """date, date_idx, symbol and the formula's value, as a plan that has not run yet.

    fields: matrices (date and a column for each symbol), numbers or expressions, by the names that the formula uses. lookback: a
    panel of earlier dates, whose rows take part in windows but not in the result."""
    return compute_all({name: formula}, panel, lookback, ops, **fields)


def compute_all(formulas: dict[str, str | Expr], panel: Panel | None = None, lookback: Panel | None = None, ops: Any = None, **fields: Any) -> DataFrame:
    """One column for each formula, over one plan that shares their common parts."""
    wide = {k: v for k, v in fields.items() if isinstance(v, DataFrame)}
    rest = {k: v for k, v in fields.items() if k not in wide}
    if wide:
        if panel is not None:
            raise ExpressionError("give a panel or matrices, not both")
        panel = Panel.from_wide(**wide)
    if panel is None:
        raise ExpressionError("no panel")
    named = {}
    for name, f in formulas.items():
        value = parse(f, rest, ops) if isinstance(f, str) else f
        named[name] = node(value)
    if lookback is None:
        return compile_nodes(panel, named)
    early = lookback.df.withColumn("_early", F.lit(True))
    all_rows = panel.df.withColumn("_early", F.lit(False)).unionByName(early, allowMissingColumns=True).drop(INDEX)
    whole = Panel.densify(all_rows.drop("_early"))
    own = panel.df.select("date").distinct()
    return compile_nodes(whole, named).join(F.broadcast(own) if own.limit(1_000_001).count() <= 1_000_000 else own, "date", "left_semi")
