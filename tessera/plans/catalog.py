"""Queries over the driver's tables, one for each operator and construct, with the SQL that says the same.

The panel is weekly supplier data of lineitem. Prices are rounded to whole numbers, so that sums are exact in any order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.plans.panel import Panel
from tessera.plans.run import compute


def weekly_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """date (weeks), symbol (suppliers), open, high, low, close, volume, xn (close with NaN in places), unit (small
    numbers), arr (an array of them), g (a group, null for some)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_quantity", F.round("l_extendedprice").alias("p"), F.struct("l_orderkey", "l_linenumber", F.round("l_extendedprice")).alias("k"))
    facts = li.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), "l_suppkey").agg(
        F.sum("l_quantity").alias("volume"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.min_by("p", "k").alias("open")
    )
    facts = facts.withColumn("symbol", F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).drop("l_suppkey")
    panel = Panel.densify(facts)
    number = F.col("symbol").cast("long")
    groups = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("symbol"), F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("g"))
    df = panel.df.join(groups, "symbol", "left")
    unit = F.col("volume") / 25.0
    return Panel(df.withColumns({"xn": F.when((F.col("date_idx") * 7 + number) % 23 == 0, M.nan()).otherwise(F.col("close")), "unit": unit, "arr": F.when(F.col("volume").isNotNull(), F.array(F.col("volume"), F.lit(None).cast("double"), F.col("high")))}))


#: The same panel in SQL: i date index, s symbol, d date.
PANEL_SQL = """
f AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS d, lpad(l_suppkey::VARCHAR, 8, '0') AS s, sum(l_quantity) AS volume, max(round(l_extendedprice)) AS high, min(round(l_extendedprice)) AS low,
    arg_max(round(l_extendedprice), l_orderkey * 100 + l_linenumber + round(l_extendedprice) / 1e7) AS close, arg_min(round(l_extendedprice), l_orderkey * 100 + l_linenumber + round(l_extendedprice) / 1e7) AS open
  FROM lineitem GROUP BY 1, 2),
c AS (SELECT d, (row_number() OVER (ORDER BY d) - 1)::INT AS i FROM (SELECT DISTINCT d FROM f)),
p AS MATERIALIZED (
  SELECT c.d, c.i, y.s, f.volume, f.high, f.low, f.close, f.open, CASE WHEN n.s_nationkey % 5 <> 0 THEN 'n' || n.s_nationkey::VARCHAR END AS g,
    CASE WHEN (c.i * 7 + y.s::BIGINT) % 23 = 0 THEN 'NaN'::DOUBLE ELSE f.close END AS xn, f.volume / 25.0 AS unit
  FROM c CROSS JOIN (SELECT DISTINCT s FROM f) y LEFT JOIN f ON f.d = c.d AND f.s = y.s LEFT JOIN supplier n ON lpad(n.s_suppkey::VARCHAR, 8, '0') = y.s)"""

S = "(PARTITION BY s ORDER BY i)"
SO_FAR = "(PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
D = "(PARTITION BY i)"
G = "(PARTITION BY i, g)"


def w(n: int) -> str:
    return f"(PARTITION BY s ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ok(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}))"


def v(x: str) -> str:
    return f"(CASE WHEN NOT isnan({x}) THEN {x} END)"


def _horner(x: str, coefficients, last: float | None = None) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in (*coefficients[1:], *([] if last is None else [last])):
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def inv_norm(p: str) -> str:
    q, r = f"({p} - 0.5::DOUBLE)", f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    tail = lambda t: f"({_horner(t, M.C)} / {_horner(t, M.D, 1.0)})"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {M.TAIL}::DOUBLE THEN {tail(lo)} WHEN {p} <= 1 - {M.TAIL}::DOUBLE THEN {_horner(r, M.A)} * {q} / {_horner(r, M.B, 1.0)} ELSE -{tail(hi)} END)"


@dataclass(frozen=True)
class Case:
    """A formula and its SQL over p; pre: further CTEs; of: the table to select from; digits: where results are rounded."""

    formula: str
    sql: str
    pre: str = ""
    of: str = "p"
    digits: int | None = 6
    ops: bool = False


def _place(x: str, part: str) -> str:
    return f"(row_number() OVER (PARTITION BY {part} ORDER BY {ok(x)} DESC, {x}, s) - 1)"


def _regression(kind: int) -> Case:
    out = [
        "b - ((my - beta * mx) + beta * a)", "beta", "my - beta * mx", "(my - beta * mx) + beta * a", "sxy / (sqrt(sxx) * sqrt(syy))", "(sxy / (sqrt(sxx) * sqrt(syy))) * (sxy / (sqrt(sxx) * sqrt(syy)))",
        "beta / nullif(sqrt(var / sxx), 0)", "(my - beta * mx) / nullif(sqrt(var * (1.0 / 6 + mx * mx / sxx)), 0)", "sqrt(var / sxx)", "sqrt(var * (1.0 / 6 + mx * mx / sxx))",
    ][kind]
    pre = f"""
t0 AS (SELECT *, CASE WHEN close IS NOT NULL AND lag(volume, 1) OVER {S} IS NOT NULL THEN lag(volume, 1) OVER {S} END AS a0 FROM p),
t1 AS (SELECT *, a0 AS a, CASE WHEN a0 IS NOT NULL THEN close END AS b FROM t0),
t2 AS (SELECT *, count(a) OVER {w(6)} AS n, avg(a) OVER {w(6)} AS mx, avg(b) OVER {w(6)} AS my, covar_pop(a, b) OVER {w(6)} * 6 AS sxy,
  CASE WHEN min(a) OVER {w(6)} < max(a) OVER {w(6)} THEN var_pop(a) OVER {w(6)} * 6 END AS sxx, CASE WHEN min(b) OVER {w(6)} < max(b) OVER {w(6)} THEN var_pop(b) OVER {w(6)} * 6 END AS syy FROM t1),
t3 AS (SELECT *, sxy / sxx AS beta, CASE WHEN coalesce(syy, 0) - sxy / sxx * sxy > 0 THEN (coalesce(syy, 0) - sxy / sxx * sxy) / 4 END AS var FROM t2)"""
    return Case(f"ts_regression(close, volume, 6, lag=1, rettype={kind})", f"CASE WHEN n = 6 AND a IS NOT NULL THEN {out} END" if kind in (0, 3) else f"CASE WHEN n = 6 THEN {out} END", pre, "t3", 4 if kind in (0, 2, 3, 9) else 5)


_XN = v("xn")
_MEAN, _DEV = f"avg({_XN}) OVER {D}", f"stddev_pop({_XN}) OVER {D}"
_LESS = f"len(list_filter(list({_XN}) FILTER (WHERE {ok('xn')}) OVER {w(6)}, lambda e: e < xn))"
_N = f"count({_XN}) OVER {w(6)}"
_FULL = "x IS NOT NULL AND y IS NOT NULL"
_PAIRS = f"t AS (SELECT *, CASE WHEN {ok('xn')} AND {ok('volume')} THEN xn END AS x, CASE WHEN {ok('xn')} AND {ok('volume')} THEN volume END AS y FROM p)"
_Q = f"(1.0::DOUBLE / n + r * (1 - 2.0::DOUBLE / n))"
_RANKED = f"t AS (SELECT *, {_place('xn', 'i')} AS k, count({_XN}) OVER {D} AS n FROM p), u AS (SELECT *, CASE WHEN n > 1 THEN k::DOUBLE / (n - 1) ELSE 0 END AS r FROM t)"

CASES: dict[str, Case] = {
    "ts_mean": Case("ts_mean(close, 5)", f"avg(close) OVER {w(5)}"),
    "ts_sum": Case("ts_sum(close, 5)", f"sum(close) OVER {w(5)}"),
    "ts_std": Case("ts_std(close, 5)", f"CASE WHEN count(close) OVER {w(5)} >= 2 THEN stddev_pop(close) OVER {w(5)} END", digits=4),
    "ts_min": Case("ts_min(close, 5)", f"min(close) OVER {w(5)}"),
    "ts_max": Case("ts_max(close, 5)", f"max(close) OVER {w(5)}"),
    "ts_delta": Case("ts_delta(close, 3)", f"close - lag(close, 3) OVER {S}"),
    "ts_delay": Case("ts_delay(close, 3)", f"lag(close, 3) OVER {S}"),
    "ts_product": Case("ts_product(unit, 3)", f"CASE WHEN count(unit) OVER {w(3)} < least(3, i + 1) THEN NULL ELSE exp(sum(ln(unit)) OVER {w(3)}) END"),
    "ts_count_nans": Case("ts_count_nans(xn, 5)", f"(count(*) OVER {w(5)} - count(xn) OVER {w(5)})::BIGINT", digits=None),
    "ts_zscore": Case("ts_zscore(close, 5)", f"CASE WHEN count(close) OVER {w(5)} >= 2 AND min(close) OVER {w(5)} < max(close) OVER {w(5)} THEN (close - avg(close) OVER {w(5)}) / stddev_samp(close) OVER {w(5)} END"),
    "ts_scale": Case("ts_scale(close, 5, 1)", f"CASE WHEN count(close) OVER {w(5)} >= 2 THEN (close - min(close) OVER {w(5)}) / nullif(max(close) OVER {w(5)} - min(close) OVER {w(5)}, 0) + 1 END"),
    "ts_av_diff": Case("ts_av_diff(close, 5)", f"CASE WHEN count(close) OVER {w(5)} = 5 THEN close - avg(close) OVER {w(5)} END"),
    "ts_step": Case("ts_step(close)", "(i + 1)::BIGINT", digits=None),
    "ts_arg_max": Case("ts_arg_max(xn, 6)", f"CASE WHEN i + 1 >= 6 AND {ok('xn')} THEN i - (max(CASE WHEN {ok('xn')} THEN {{'x': xn, 'j': i}} END) OVER {w(6)})['j'] END"),
    "ts_arg_min": Case("ts_arg_min(xn, 6)", f"CASE WHEN i + 1 >= 6 AND {ok('xn')} THEN i + (min(CASE WHEN {ok('xn')} THEN {{'x': xn, 'j': -i}} END) OVER {w(6)})['j'] END"),
    "ts_backfill": Case("ts_backfill(close, 2)", f"coalesce(close, lag(close, 1) OVER {S}, lag(close, 2) OVER {S})"),
    "kth_element": Case("kth_element(close, 5, 2)", f"lag(close, 2) OVER {S}"),
    "last_diff_value": Case("last_diff_value(xn, 4)", f"CASE WHEN {ok('xn')} THEN list_filter(list({_XN}) FILTER (WHERE {ok('xn')}) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda e: e <> xn)[-1] END"),
    "days_from_last_change": Case(
        "days_from_last_change(ts_backfill(xn, 3))", f"i - max(CASE WHEN c THEN i END) OVER {SO_FAR}",
        f"t AS (SELECT *, coalesce(xn, lag(xn, 1) OVER {S}, lag(xn, 2) OVER {S}, lag(xn, 3) OVER {S}) AS x FROM p), u AS (SELECT *, i = 0 OR x IS DISTINCT FROM lag(x) OVER {S} OR coalesce(isnan(x), false) AS c FROM t)", "u", None),
    "hump": Case(
        "hump(xn, 0.0001)", "h",
        f"""lim AS MATERIALIZED (SELECT i, s, xn, coalesce(sum(abs({_XN})) OVER {D}, 0) * 0.0001::DOUBLE AS m FROM p),
h AS (SELECT i, s, xn AS h FROM lim WHERE i = 0
  UNION ALL SELECT l.i, l.s, CASE WHEN NOT {ok('l.xn')} OR NOT {ok('h.h')} THEN l.xn ELSE h.h + sign(l.xn - h.h) * least(abs(l.xn - h.h), l.m) END FROM h JOIN lim l ON l.i = h.i + 1 AND l.s = h.s),
t AS (SELECT p.*, h.h FROM p JOIN h USING (i, s))""", "t", 4),
    "ts_decay_linear": Case("ts_decay_linear(xn, 4)", f"CASE WHEN count({_XN}) OVER {w(4)} = 4 THEN (sum({_XN} * i) OVER {w(4)} - (i - 4) * sum({_XN}) OVER {w(4)}) / 10 END"),
    "ts_decay_linear_dense": Case("ts_decay_linear(close, 4, dense=1)", f"CASE WHEN i >= 3 THEN (sum(close * i) OVER {w(4)} - (i - 4) * sum(close) OVER {w(4)}) / nullif(sum(CASE WHEN close IS NOT NULL THEN i END) OVER {w(4)} - (i - 4) * count(close) OVER {w(4)}, 0) END"),
    "ts_rank": Case("ts_rank(xn, 6, 1)", f"CASE WHEN {ok('xn')} THEN CASE WHEN {_N} = 1 THEN 1.5 ELSE 1 + {_LESS}::DOUBLE / nullif({_N} - 1, 0) END END"),
    "ts_corr": Case("ts_corr(xn, volume, 6)", f"CASE WHEN count(x) OVER {w(6)} = 6 AND min(x) OVER {w(6)} < max(x) OVER {w(6)} AND min(y) OVER {w(6)} < max(y) OVER {w(6)} THEN covar_pop(x, y) OVER {w(6)} / (stddev_pop(x) OVER {w(6)} * stddev_pop(y) OVER {w(6)}) END", _PAIRS, "t"),
    "ts_covariance": Case("ts_covariance(xn, volume, 6)", f"CASE WHEN count(x) OVER {w(6)} = 6 THEN covar_pop(x, y) OVER {w(6)} END", _PAIRS, "t", 3),
    "ts_quantile": Case("ts_quantile(xn, 6)", f"CASE WHEN {ok('xn')} THEN CASE WHEN n = 1 THEN 0 ELSE {inv_norm('((l + 0.5::DOUBLE) / n)')} END END", f"t AS (SELECT *, {_LESS} AS l, {_N} AS n FROM p)", "t"),
    "ts_quantile_uniform": Case("ts_quantile(xn, 6, 'uniform')", f"CASE WHEN {ok('xn')} THEN CASE WHEN n = 1 THEN 0 ELSE 2 * (l + 0.5::DOUBLE) / n - 1 END END", f"t AS (SELECT *, {_LESS} AS l, {_N} AS n FROM p)", "t"),
    **{f"ts_regression_{k}": _regression(k) for k in range(10)},
    "rank": Case("rank(xn)", f"CASE WHEN {ok('xn')} THEN r END", _RANKED, "u"),
    "zscore": Case("zscore(xn)", f"CASE WHEN min({_XN}) OVER {D} < max({_XN}) OVER {D} THEN ({_XN} - {_MEAN}) / {_DEV} END"),
    "scale": Case("scale(xn, 10)", f"{_XN} * 10 / nullif(sum(abs({_XN})) OVER {D}, 0)"),
    "scale_sides": Case("scale(ts_delta(close, 1), longscale=4, shortscale=3)", f"CASE WHEN x > 0 THEN x / sum(CASE WHEN x > 0 THEN x END) OVER {D} * 4 WHEN x < 0 THEN x / sum(CASE WHEN x < 0 THEN -x END) OVER {D} * 3 ELSE 0 END", f"t AS (SELECT *, close - lag(close) OVER {S} AS x FROM p)", "t"),
    "normalize": Case("normalize(xn, useStd=1, limit=1.5)", f"CASE WHEN {ok('xn')} AND min({_XN}) OVER {D} < max({_XN}) OVER {D} THEN greatest(-1.5, least(1.5, ({_XN} - {_MEAN}) / {_DEV})) END"),
    "quantile": Case("quantile(xn)", f"CASE WHEN {ok('xn')} THEN CASE WHEN n <= 1 THEN 0 ELSE {inv_norm(_Q)} END END", _RANKED, "u"),
    "quantile_cauchy": Case("quantile(xn, 'cauchy', 2)", f"CASE WHEN {ok('xn')} THEN CASE WHEN n <= 1 THEN 0 ELSE tan(pi() * ({_Q} - 0.5::DOUBLE)) * 2 END END", _RANKED, "u", 4),
    "quantile_uniform": Case("quantile(xn, 'uniform')", f"CASE WHEN {ok('xn')} THEN CASE WHEN n <= 1 THEN 0 ELSE 2 * ({_Q} - 0.5::DOUBLE) END END", _RANKED, "u"),
    "winsorize": Case("winsorize(xn, 1)", f"CASE WHEN {ok('xn')} THEN greatest({_MEAN} - {_DEV}, least({_MEAN} + {_DEV}, xn)) END", digits=4),
    "bucket": Case("bucket(xn, '0,60000,5000')", f"CASE WHEN {ok('xn')} THEN greatest(0, least(55000, floor(xn / 5000) * 5000)) END"),
    "group_neutralize": Case("group_neutralize(xn, g)", f"CASE WHEN g IS NOT NULL THEN {_XN} - avg({_XN}) OVER {G} END"),
    "group_zscore": Case("group_zscore(xn, g)", f"CASE WHEN g IS NOT NULL AND min({_XN}) OVER {G} < max({_XN}) OVER {G} THEN ({_XN} - avg({_XN}) OVER {G}) / stddev_pop({_XN}) OVER {G} END"),
    "group_scale": Case("group_scale(xn, g)", f"CASE WHEN g IS NOT NULL THEN ({_XN} - min({_XN}) OVER {G}) / nullif(max({_XN}) OVER {G} - min({_XN}) OVER {G}, 0) END"),
    "group_rank": Case("group_rank(xn, g)", f"CASE WHEN g IS NOT NULL AND {ok('xn')} THEN CASE WHEN count({_XN}) OVER {G} = 1 THEN 0.5 ELSE {_place('xn', 'i, g')}::DOUBLE / nullif(count({_XN}) OVER {G} - 1, 0) END END"),
    "group_mean": Case("group_mean(xn, volume, g)", f"CASE WHEN g IS NOT NULL THEN sum(x * y) OVER {G} / nullif(sum(y) OVER {G}, 0) END", _PAIRS, "t"),
    "group_backfill": Case(
        "group_backfill(xn, g, 3, 1)", f"CASE WHEN {ok('xn')} THEN xn ELSE fill END",
        f"""b AS (SELECT g, i, list({_XN}) FILTER (WHERE {ok('xn')}) AS l FROM p WHERE g IS NOT NULL GROUP BY g, i),
e AS (SELECT b.g, b.i, unnest(coalesce(o.l, [])) AS x FROM b JOIN b o ON o.g = b.g AND o.i BETWEEN b.i - 2 AND b.i),
m AS (SELECT g, i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY g, i),
z AS (SELECT e.g, e.i, avg(greatest(m.m - m.sd, least(m.m + m.sd, e.x))) AS fill FROM e JOIN m USING (g, i) GROUP BY e.g, e.i),
t AS (SELECT p.*, z.fill FROM p LEFT JOIN z ON z.g = p.g AND z.i = p.i)""", "t", 4),
    "abs": Case("abs(ts_delta(close, 1))", f"abs(close - lag(close) OVER {S})"),
    "add": Case("add(close, volume, high, filter=1)", "coalesce(close, 0) + coalesce(volume, 0) + coalesce(high, 0)"),
    "subtract": Case("subtract(close, ts_delay(open, 1), filter=1)", f"coalesce(close, 0) - coalesce(lag(open) OVER {S}, 0)"),
    "multiply": Case("multiply(close, 2, ts_delay(unit, 1), filter=1)", f"coalesce(close, 1) * 2 * coalesce(lag(unit) OVER {S}, 1)"),
    "divide": Case("divide(close, high - low)", "close / nullif(high - low, 0)"),
    "inverse": Case("inverse(high - low)", "1 / nullif(high - low, 0)"),
    "log": Case("ops.log(high - low)", "CASE WHEN high - low > 0 THEN ln(high - low) END"),
    "max": Case("ops.max(close, ts_delay(open, 1), 20000)", f"greatest(close, lag(open) OVER {S}, 20000)"),
    "min": Case("ops.min(close, ts_delay(open, 1), 20000)", f"least(close, lag(open) OVER {S}, 20000)"),
    "power": Case("power(unit, 2)", "unit * unit"),
    "signed_power": Case("signed_power(ts_delta(close, 1), 0.5)", "sign(x) * sqrt(abs(x))", f"t AS (SELECT *, close - lag(close) OVER {S} AS x FROM p)", "t"),
    "sqrt": Case("ops.sqrt(ts_delta(close, 1))", "CASE WHEN x >= 0 THEN sqrt(x) END", f"t AS (SELECT *, close - lag(close) OVER {S} AS x FROM p)", "t"),
    "sign": Case("ops.sign(ts_delta(close, 1))", f"sign(close - lag(close) OVER {S})::DOUBLE"),
    "reverse": Case("reverse(close)", "-close"),
    "densify": Case("densify(bucket(xn, '0,60000,5000'))", f"CASE WHEN x IS NOT NULL THEN dense_rank() OVER (PARTITION BY i ORDER BY x IS NULL, x) - 1 END", f"t AS (SELECT *, CASE WHEN {ok('xn')} THEN greatest(0, least(55000, floor(xn / 5000) * 5000)) END AS x FROM p)", "t"),
    "and_": Case("and_(gt(close, 20000), gt(volume, 30))", "close > 20000 AND volume > 30", digits=None),
    "or_": Case("or_(gt(close, 20000), gt(ts_delay(volume, 1), 30))", f"close > 20000 OR lag(volume) OVER {S} > 30", digits=None),
    "not_": Case("not_(gt(close, 20000))", "NOT (close > 20000)", digits=None),
    "if_else": Case("if_else(gt(close, 20000), high, 1)", "CASE WHEN close > 20000 THEN high ELSE 1 END"),
    "is_nan": Case("is_nan(xn)", "xn IS NULL OR isnan(xn)", digits=None),
    "lt": Case("lt(close, ts_delay(close, 1))", f"close < lag(close) OVER {S}", digits=None),
    "le": Case("le(open, close)", "open <= close", digits=None),
    "gt": Case("gt(close, ts_delay(close, 1))", f"close > lag(close) OVER {S}", digits=None),
    "ge": Case("ge(open, close)", "open >= close", digits=None),
    "eq": Case("eq(open, close)", "open = close", digits=None),
    "ne": Case("ne(open, close)", "open <> close", digits=None),
    "vec_avg": Case("vec_avg(arr)", "(volume + high) / 2"),
    "vec_sum": Case("vec_sum(arr)", "volume + high"),
    "trade_when": Case(
        "trade_when(gt(volume, 40), close, lt(volume, 10))", "(e)['v']",
        f"t AS (SELECT *, max(CASE WHEN volume < 10 THEN {{'j': i, 'v': NULL::DOUBLE}} WHEN volume > 40 THEN {{'j': i, 'v': coalesce(close, NULL)}} END) OVER {SO_FAR} AS e FROM p)", "t"),
    # the language
    "lang_momentum": Case("rank(-ts_delta(close, 5))", f"CASE WHEN x IS NOT NULL THEN CASE WHEN n = 1 THEN 0 ELSE k::DOUBLE / nullif(n - 1, 0) END END", f"t0 AS (SELECT *, -(close - lag(close, 5) OVER {S}) AS x FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x IS NULL, x, s) - 1 AS k, count(x) OVER {D} AS n FROM t0)", "t"),
    "lang_arithmetic": Case("(close + 1) * 2 - high / (high - low) ** 2", "CASE WHEN high = low THEN '-Infinity'::DOUBLE ELSE (close + 1) * 2 - high / ((high - low) * (high - low)) END", digits=4),
    "lang_compare": Case("(close > open) + (close >= open) + (close < open) + (close <= open) + (close == open) + (close != open)", "(close > open)::INT + (close >= open)::INT + (close < open)::INT + (close <= open)::INT + (close = open)::INT + (close <> open)::INT"),
    "lang_logic": Case("((close > 20000) & (volume > 30)) | ~(high > 30000)", "(coalesce(NOT (high > 30000), false) OR (close > 20000 AND volume > 30))::INT"),
    "lang_chain": Case("10000 < close < 30000", "(10000 < close AND close < 30000)::INT"),
    "lang_bool": Case("close > 20000 and volume > 30 or high > 40000", "((close > 20000 AND volume > 30) OR high > 40000)::INT"),
    "lang_ternary": Case("high if close > 20000 else low", "CASE WHEN close > 20000 THEN high ELSE low END"),
    "lang_sequence": Case("a = ts_mean(close, 5); b = ts_mean(close, 10)\na - b", f"avg(close) OVER {w(5)} - avg(close) OVER {w(10)}"),
    "lang_builtins": Case("log(high) + sqrt(low) + sign(close) + abs(-volume) + min(open, close) + max(open, close, 100)", "ln(high) + sqrt(low) + sign(close) + volume + least(open, close) + greatest(open, close, 100)"),
    "lang_divide": Case("if_else(is_nan(1 / (high - low)), 0, 1) + (1 / (high - low) > 1000000)", "CASE WHEN high IS NULL THEN NULL ELSE 1 + (high = low)::INT END"),
    "lang_nested": Case("zscore(ts_mean(ts_delta(close, 1), 4)) * rank(volume)", f"CASE WHEN lo < hi AND volume IS NOT NULL THEN (y - m) / sd * k::DOUBLE / nullif(n - 1, 0) END", f"t0 AS (SELECT *, close - lag(close) OVER {S} AS x FROM p), t1 AS (SELECT *, avg(x) OVER {w(4)} AS y FROM t0), t AS (SELECT *, min(y) OVER {D} AS lo, max(y) OVER {D} AS hi, avg(y) OVER {D} AS m, stddev_pop(y) OVER {D} AS sd, row_number() OVER (PARTITION BY i ORDER BY volume IS NULL, volume, s) - 1 AS k, count(volume) OVER {D} AS n FROM t1)", "t"),
    "lang_group": Case("group_neutralize(rank(close), g)", f"CASE WHEN g IS NOT NULL THEN r - avg(r) OVER {G} END", f"t AS (SELECT *, CASE WHEN close IS NOT NULL THEN (row_number() OVER (PARTITION BY i ORDER BY close IS NULL, close, s) - 1)::DOUBLE / nullif(count(close) OVER {D} - 1, 0) END AS r FROM p)", "t"),
}


def shift(digits: int) -> float:
    return 1.7 * 10.0 ** -(digits + 1)


def rounded(c: Column, digits: int) -> Column:
    """As DuckDB rounds doubles: scaled, to the nearest whole number, scaled back. F.round goes by decimal digits instead, and
    parts from it where scaling gives an exact half that the digits are not, such as 3375.9980499999997 to four digits."""
    scaled = c * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(M.INF), F.round(scaled) / F.lit(10.0**digits)).otherwise(c)


def settle(c: Column, kind: str, digits: int | None) -> Column:
    """NaN as null, and rounded, for comparison; infinities stay."""
    if kind not in ("double", "float") or digits is None:
        return c.cast("bigint") if kind in ("int", "bigint") else c
    # a small shift keeps exact halves from rounding by the last bit; adding 0.0 turns a negative zero into a positive one
    return F.when(~F.isnan(c), rounded(c + F.lit(shift(digits)), digits) + F.lit(0.0))


def query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute(case.formula, weekly_panel(spark, sf_dir))
        return out.select("date", "symbol", settle(F.col("value"), dict(out.dtypes)["value"], case.digits).alias("value"))

    run.__doc__ = case.formula
    return run


def oracle(case: Case) -> str:
    value = f"({case.sql})"
    if case.digits is not None:
        value = f"CASE WHEN isnan({value}::DOUBLE) THEN NULL ELSE round({value}::DOUBLE + {shift(case.digits)!r}::DOUBLE, {case.digits}) + 0.0::DOUBLE END"
    elif "::BIGINT" in case.sql or case.sql.startswith("i -"):
        value = f"{value}::BIGINT"
    return f"WITH RECURSIVE {PANEL_SQL}{',' + case.pre if case.pre else ''}\nSELECT d AS date, s AS symbol, {value} AS value FROM {case.of}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: query(c) for k, c in CASES.items()}
ORACLE_SQL: dict[str, str] = {k: oracle(c) for k, c in CASES.items()}
