"""What a formula's plan is made of, operator by operator, and what its nodes measured in a run.

Formulas are lazy and their operators share nodes of the plan, so calls are counted and seconds belong to nodes."""

from __future__ import annotations

import ast
import re
import textwrap
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.plans.expr import Expr, node
from tessera.plans.language import parse


@dataclass(frozen=True)
class Profile:
    operators: Counter
    windows: int
    levels: int
    exchanges: int
    nodes: Counter


@dataclass(frozen=True)
class Step:
    """A node of the plan that ran: its depth below the result, and the rows, milliseconds and bytes that it measured itself
    (null where it measures none; milliseconds are summed over tasks)."""

    node: str
    depth: int
    rows: int | None
    milliseconds: float | None
    size: int | None


#: What nodes call their measures: (name, its unit in milliseconds).
TIMES = {"pipelineTime": 1.0, "sortTime": 1.0, "aggTime": 1.0, "buildTime": 1.0, "broadcastTime": 1.0, "scanTime": 1.0, "shuffleWriteTime": 1e-6, "pythonTotalTime": 1.0}
ROWS = ("numOutputRows", "pythonNumRowsReceived", "shuffleRecordsWritten")


def measured(df: DataFrame) -> list[Step]:
    """Runs df once, drops its rows, and gives the nodes of the plan as it ended, from the result downwards."""
    run = df.select("*")._jdf.queryExecution()
    run.toRdd().count()
    out: list[Step] = []

    def visit(plan, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return visit(plan.plan(), depth)
        held, values = plan.metrics().iterator(), {}
        while held.hasNext():
            entry = held.next()
            values[entry._1()] = int(entry._2().value())
        rows = next((values[k] for k in ROWS if k in values), None)
        times = [values[k] * unit for k, unit in TIMES.items() if k in values]
        out.append(Step(re.sub(r"\W.*", "", plan.nodeName()), depth, rows, sum(times) if times else None, values.get("dataSize")))
        below = plan.children().iterator()
        while below.hasNext():
            visit(below.next(), depth + 1)

    visit(run.executedPlan(), 0)
    return out


def profile(formula: str | Expr, df: DataFrame | None = None) -> Profile:
    """Operators used (of a text: as called in it; of an expression: its nodes), distinct windowed columns, levels, and, given the computed DataFrame, nodes of its physical plan."""
    root = node(parse(formula) if isinstance(formula, str) else formula)
    seen = list(root.walk())
    used = Counter(n.name for n in seen if n.kind in ("cell", "window"))
    if isinstance(formula, str):
        calls = [n.func for n in ast.walk(ast.parse(textwrap.dedent(formula).strip())) if isinstance(n, ast.Call)]
        used = Counter(f.attr if isinstance(f, ast.Attribute) else f.id for f in calls)
    text = df._jdf.queryExecution().executedPlan().toString() if df is not None else ""
    nodes = Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M))
    return Profile(used, sum(n.kind == "window" for n in seen), root.level, nodes["Exchange"], nodes)
