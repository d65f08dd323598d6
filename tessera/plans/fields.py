"""The registry of fields: what each is made of, and building them all on one panel.

Every field is a column of the panel; only lags and fills need a window by symbol, all of one exchange."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.errors import UnknownFieldError
from tessera.plans.panel import Panel

PRICE, COMPUTED, FILED, DERIVED, LABEL = "price", "computed", "filed", "derived", "label"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    #: The price column or the filed concept that it is taken from.
    source: str | None = None
    needs: tuple[str, ...] = ()


#: Names of fields, and the filed concepts behind those that are named otherwise.
PRICES = ("close", "open", "high", "low", "volume", "vwap")
CONCEPTS = (
    "sharesout", "dividend", "assets", "liabilities", "operating_income", "sales", "capex", "equity", "debt_lt", "assets_curr", "goodwill", "income",
    "revenue", "cashflow_op", "cash", "cogs", "liabilities_curr", "debt_st", "ppent", "cashflow", "inventory", "cash_st", "receivable", "sga_expense",
    "retained_earnings", "cashflow_fin", "income_tax", "pretax_income", "cashflow_invest", "cashflow_dividends", "depre_amort",
)
RENAMED = {
    "fnd6_drft": "dr_lt", "fnd6_drc": "dr_st", "fnd6_ivaco": "invest_activity_other", "income_beforeextra": "income_before_extra",
    "fnd6_acdo": "assets_discontinued", "fnd6_clother": "other_income_nt", "fnd6_xrent": "rental_expense",
}
SUMS = {"debt": ("debt_lt", "debt_st"), "ebitda": ("operating_income", "depre_amort"), "operating_expense": ("cogs", "sga_expense", "depre_amort")}
LESS_LAST = {"working_capital": ("assets_curr", "liabilities_curr"), "invested_capital": ("equity", "debt_lt", "cash"), "enterprise_value": ("cap", "debt_lt", "cash")}
RATIOS = {
    "eps": ("income", "sharesout"), "bookvalue_ps": ("equity", "sharesout"), "current_ratio": ("assets_curr", "liabilities_curr"), "return_equity": ("income", "equity"),
    "return_assets": ("income", "assets"), "sales_ps": ("sales", "sharesout"), "inventory_turnover": ("cogs", "inventory"),
}
LABELS = ("sector", "industry", "subindustry", "exchange")
QUARTER_ROWS, ADV_ROWS = 63, 20


def _registry() -> dict[str, Field]:
    out = {p: Field(p, PRICE, p) for p in PRICES}
    out |= {"returns": Field("returns", COMPUTED, needs=("close",)), "adv20": Field("adv20", COMPUTED, needs=("volume",)), "cap": Field("cap", COMPUTED, needs=("close", "sharesout")), "split": Field("split", COMPUTED)}
    out |= {c: Field(c, FILED, c) for c in CONCEPTS} | {k: Field(k, FILED, c) for k, c in RENAMED.items()}
    out |= {k: Field(k, DERIVED, needs=n) for k, n in (SUMS | LESS_LAST | RATIOS).items()} | {"sales_growth": Field("sales_growth", DERIVED, needs=("sales",))}
    return out | {x: Field(x, LABEL, x) for x in LABELS}


FIELDS: dict[str, Field] = _registry()


def build_order(names: set[str] | None = None) -> list[str]:
    """Fields, and all that they need, each after what it needs."""
    want = set(FIELDS if names is None else names)
    if unknown := want - set(FIELDS):
        raise UnknownFieldError(", ".join(sorted(unknown)))
    todo = list(want)
    while todo:
        for n in FIELDS[todo.pop()].needs:
            if n not in want:
                want.add(n)
                todo.append(n)
    return list(TopologicalSorter({n: set(FIELDS[n].needs) for n in sorted(want)}).static_order())


def _formula(name: str) -> Column:
    s = Window.partitionBy("symbol").orderBy("date_idx")
    c = F.col
    if name == "returns":
        return F.try_divide(c("close"), F.lag("close").over(s)) - 1
    if name == "adv20":
        full = s.rowsBetween(-(ADV_ROWS - 1), 0)
        return F.when(F.count("volume").over(full) == ADV_ROWS, F.avg("volume").over(full))
    if name == "cap":
        return c("close") * c("sharesout")
    if name == "split":
        return F.lit(1.0)
    if name == "sales_growth":
        return F.try_divide(c("sales"), F.lag("sales", QUARTER_ROWS).over(s)) - 1
    if name in SUMS:
        return reduce(lambda a, b: a + b, map(c, SUMS[name]))
    if name in LESS_LAST:
        *more, last = map(c, LESS_LAST[name])
        return reduce(lambda a, b: a + b, more) - last
    a, b = RATIOS[name]
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def build(calendar: DataFrame, ticks: DataFrame, filed: DataFrame | None = None, master: DataFrame | None = None, names: set[str] | None = None) -> Panel:
    """A panel of fields on calendar (date).

    ticks: symbol, date and price columns. filed: symbol, date, concept, value; a figure counts from its date on, if that is
    a date of the calendar, until the next. master: symbol, labels and start_date; a symbol's latest label holds throughout."""
    order = build_order(names)
    kinds = {k: [n for n in order if FIELDS[n].kind == k] for k in (PRICE, FILED, LABEL)}
    prices = [n for n in kinds[PRICE] if FIELDS[n].source in ticks.columns]
    facts = ticks.select("date", "symbol", *(F.col(FIELDS[n].source).cast("double").alias(n) for n in prices))
    symbols = ticks.select("symbol").distinct()
    if kinds[FILED] and filed is not None:
        sources = sorted({FIELDS[n].source for n in kinds[FILED]})
        # concepts are of a fixed number: one column each, in one aggregation
        wide = filed.groupBy("date", "symbol").agg(*(F.max(F.when(F.col("concept") == s, F.col("value"))).alias(f"_{s}") for s in sources))
        symbols = symbols.union(filed.select("symbol")).distinct()
        facts = facts.join(wide, ["date", "symbol"], "full_outer")
    panel = Panel.densify(facts, calendar, symbols)
    df = panel.df
    so_far = Window.partitionBy("symbol").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    new = {n: F.lit(None).cast("double") for n in kinds[PRICE] if n not in prices}
    for n in kinds[FILED]:
        new[n] = F.last(f"_{FIELDS[n].source}", ignorenulls=True).over(so_far) if filed is not None else F.lit(None).cast("double")
    df = df.withColumns(new) if new else df
    if kinds[LABEL]:
        if master is not None:
            have = [x for x in kinds[LABEL] if x in master.columns]
            labels = master.groupBy("symbol").agg(*(F.max_by(x, F.struct("start_date", x)).alias(x) for x in have))
            df = df.join(labels, "symbol", "left")
        df = df.withColumns({x: F.lit(None).cast("string") for x in kinds[LABEL] if x not in df.columns})
    for n in order:
        if FIELDS[n].kind in (COMPUTED, DERIVED):
            df = df.withColumn(n, _formula(n))
    wanted = sorted(FIELDS if names is None else names)
    return Panel(df.select("date", "date_idx", "symbol", *wanted))
