"""Queries for the data layer: fields, securities, universes, filed figures, the journal and sources, with their SQL.

Securities are suppliers: a supplier trades under symbol T<n> for the first half of its life and U<n> after. Filed figures are
monthly sums of orders by customer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import journal
from tessera.plans.catalog import PANEL_SQL, D, S, settle, shift, weekly_panel, w
from tessera.plans.fields import CONCEPTS, RENAMED, build
from tessera.plans.panel import Panel
from tessera.plans.run import compute_all
from tessera.sources import fundamentals, master_build, tagging, ticks, universe
from tessera.sources.calendar import TradingCalendar
from tessera.sources.security_master import SecurityMaster, normal_ticker, padded_cik, sec_ticker, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _case(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE + {shift(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(settle(F.col(c), t, digits).alias(c) for c, t in df.dtypes))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, close, volume and more: weekly bars, named as ticks."""
    return weekly_panel(spark, sf_dir).df.filter("close IS NOT NULL").select("date", "symbol", "open", "high", "low", "close", "volume")


def _filing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar of every symbol in a quarter: its figures are filed that day."""
    p = weekly_panel(spark, sf_dir).df.filter("close IS NOT NULL").withColumn("quarter", F.quarter("date"))
    first = Window.partitionBy("symbol", F.year("date"), "quarter").orderBy("date_idx")
    return p.withColumn("n", F.row_number().over(first)).filter("n = 1")


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, concept, value: figures of suppliers, quarterly."""
    p = _filing_days(spark, sf_dir)
    return p.select("date", "symbol", F.posexplode(F.array("volume", "high", "low", "close", "open")).alias("k", "value")).withColumn("concept", F.element_at(F.array(*map(F.lit, ("sharesout", "income", "equity", "sales", "debt_lt"))), F.col("k") + 1)).drop("k")


_FILED = """
z AS (SELECT p.*, CASE WHEN close IS NOT NULL AND row_number() OVER (PARTITION BY s, date_trunc('quarter', d), close IS NULL ORDER BY i) = 1 THEN i END AS fi FROM p),
y AS (SELECT z.*, last_value(CASE WHEN fi IS NOT NULL THEN volume END IGNORE NULLS) OVER so AS sharesout, last_value(CASE WHEN fi IS NOT NULL THEN high END IGNORE NULLS) OVER so AS income,
  last_value(CASE WHEN fi IS NOT NULL THEN low END IGNORE NULLS) OVER so AS equity, last_value(CASE WHEN fi IS NOT NULL THEN close END IGNORE NULLS) OVER so AS sales,
  last_value(CASE WHEN fi IS NOT NULL THEN open END IGNORE NULLS) OVER so AS debt_lt
  FROM z WINDOW so AS (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

#: What the registry takes from filings: concept by field, and the number by which its figures are told apart.
_FILINGS = {c: c for c in CONCEPTS} | RENAMED
_NUMBER = {c: k for k, c in enumerate(_FILINGS.values())}


def all_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, concept, value for every concept; each is left out of one quarter in three."""
    p = _filing_days(spark, sf_dir)
    numbered = F.explode(F.create_map(*(F.lit(x) for c, k in _NUMBER.items() for x in (c, k)))).alias("concept", "k")
    rows = p.select("date", "symbol", "quarter", "volume", "high", numbered).filter((F.col("quarter") + F.col("k")) % 3 != 0)
    return rows.select("date", "symbol", "concept", (F.col("volume") * (F.col("k") % 5 + 1) + F.col("high") + F.col("k") * 10).alias("value"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, start_date and labels: two rows a supplier, the older one without an exchange."""
    s = _read(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    row = lambda year, shift, exchange: s.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("symbol"), F.lit(f"{year}-01-01").cast("date").alias("start_date"), *(F.concat(F.lit(x), ((n + shift) % m).cast("string")).alias(c) for c, x, m in (("sector", "s", 3), ("industry", "i", 7), ("subindustry", "u", 11))), exchange.alias("exchange"))
    return row(2020, 0, F.lit(None).cast("string")).unionByName(row(2021, 1, F.concat(F.lit("x"), (n % 2).cast("string"))))


def _all_fields_sql() -> str:
    carried = ", ".join(f"last_value(CASE WHEN fi IS NOT NULL AND (quarter(d) + {_NUMBER[c]}) % 3 <> 0 THEN volume * {_NUMBER[c] % 5 + 1} + high + {_NUMBER[c] * 10} END IGNORE NULLS) OVER so AS {f}" for f, c in _FILINGS.items())
    formulas = {
        "vwap": "(high + low + close) / 3", "returns": f"close / nullif(lag(close) OVER {S}, 0) - 1", "adv20": f"CASE WHEN count(volume) OVER {w(20)} = 20 THEN avg(volume) OVER {w(20)} END", "cap": "close * sharesout", "split": "1.0",
        "debt": "debt_lt + debt_st", "ebitda": "operating_income + depre_amort", "operating_expense": "cogs + sga_expense + depre_amort", "working_capital": "assets_curr - liabilities_curr", "invested_capital": "equity + debt_lt - cash",
        "enterprise_value": "close * sharesout + debt_lt - cash", "eps": "income / nullif(sharesout, 0)", "bookvalue_ps": "equity / nullif(sharesout, 0)", "current_ratio": "assets_curr / nullif(liabilities_curr, 0)", "return_equity": "income / nullif(equity, 0)",
        "return_assets": "income / nullif(assets, 0)", "sales_ps": "sales / nullif(sharesout, 0)", "inventory_turnover": "cogs / nullif(inventory, 0)", "sales_growth": f"sales / nullif(lag(sales, 63) OVER {S}, 0) - 1",
    } | {c: c for c in ("close", "open", "high", "low", "volume", *_FILINGS)}
    columns = ", ".join(f"{_r(x)} AS {c}" for c, x in formulas.items())
    labels = ", ".join(f"'{x}' || ((l.s_nationkey + 1) % {m})::VARCHAR AS {c}" for c, x, m in (("sector", "s", 3), ("industry", "i", 7), ("subindustry", "u", 11)))
    return f"""WITH RECURSIVE {PANEL_SQL},
z AS (SELECT p.*, CASE WHEN close IS NOT NULL AND row_number() OVER (PARTITION BY s, date_trunc('quarter', d), close IS NULL ORDER BY i) = 1 THEN i END AS fi FROM p),
y AS (SELECT z.*, {carried} FROM z WINDOW so AS (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT d AS date, s AS symbol, {columns}, {labels}, 'x' || (l.s_nationkey % 2)::VARCHAR AS exchange FROM y LEFT JOIN supplier l ON lpad(l.s_suppkey::VARCHAR, 8, '0') = y.s"""


@_case(_all_fields_sql())
def fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the registry."""
    t = daily(spark, sf_dir).withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return _rounded(build(t.select("date"), t, all_filed(spark, sf_dir), labelled(spark, sf_dir)).df.drop("date_idx"))


@_case(f"WITH RECURSIVE {PANEL_SQL} SELECT d AS date, s AS symbol, {_r(f'close / nullif(lag(close) OVER {S}, 0) - 1')} AS returns, CASE WHEN count(volume) OVER {w(20)} = 20 THEN {_r(f'avg(volume) OVER {w(20)}')} END AS adv20, {_r('1.0')} AS split FROM p")
def fields_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed price fields of the registry."""
    t = daily(spark, sf_dir)
    return _rounded(build(t.select("date"), t, names={"returns", "adv20", "split"}).df.drop("date_idx"))


@_case(f"WITH RECURSIVE {PANEL_SQL},{_FILED} SELECT d AS date, s AS symbol, {_r('sharesout')} AS sharesout, {_r('income')} AS income, {_r('close * sharesout')} AS cap, {_r('income / nullif(sharesout, 0)')} AS eps, {_r('income / nullif(equity, 0)')} AS return_equity, {_r(f'sales / nullif(lag(sales, 63) OVER {S}, 0) - 1')} AS sales_growth FROM y")
def fields_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed fields, carried forward, and what is derived from them."""
    t = daily(spark, sf_dir)
    return _rounded(build(t.select("date"), t, filed(spark, sf_dir), names={"sharesout", "income", "cap", "eps", "return_equity", "sales_growth"}).df.drop("date_idx"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    half = lambda p, a, b: s.select(
        F.col("s_suppkey").alias("security_id"), F.concat(F.lit(p), (F.col("s_suppkey") % 40).cast("string")).alias("symbol"), F.col("s_name").alias("company"), padded_cik(F.col("s_suppkey")).alias("cik"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") * 37 % 700 + a).cast("int")).alias("start_date"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") * 37 % 700 + b).cast("int")).alias("end_date"),
    )
    return half("T", 0, 199).unionByName(half("U", 200, 900))


_MASTER = """
m AS (
  SELECT s_suppkey AS security_id, 'T' || (s_suppkey % 40)::VARCHAR AS symbol, s_name AS company, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, DATE '2020-01-01' + (s_suppkey * 37 % 700)::INT AS start_date, DATE '2020-01-01' + (s_suppkey * 37 % 700 + 199)::INT AS end_date FROM supplier
  UNION ALL SELECT s_suppkey, 'U' || (s_suppkey % 40)::VARCHAR, s_name, lpad(s_suppkey::VARCHAR, 10, '0'), DATE '2020-01-01' + (s_suppkey * 37 % 700 + 200)::INT, DATE '2020-01-01' + (s_suppkey * 37 % 700 + 900)::INT FROM supplier)"""
_DAYS = "(SELECT t.symbol, d::DATE AS day FROM (SELECT DISTINCT symbol FROM m) t CROSS JOIN (VALUES (DATE '2020-06-15'), (DATE '2021-03-01'), (DATE '2022-09-30')) v(d))"


@_case(f"WITH {_MASTER}, r AS (SELECT symbol AS identifier, m.*, 0 AS place FROM m UNION ALL SELECT security_id::VARCHAR, m.*, 1 FROM m UNION ALL SELECT cik, m.*, 2 FROM m), v AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY place, start_date, security_id::VARCHAR) AS n FROM r WHERE start_date <= DATE '2021-03-01' AND end_date >= DATE '2021-03-01') SELECT i.identifier, v.security_id, v.symbol FROM (SELECT DISTINCT identifier FROM r) i LEFT JOIN v ON v.identifier = i.identifier AND v.n = 1")
def master_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier as of a day."""
    m = master(spark, sf_dir)
    ids = m.select(F.explode(F.array("symbol", F.col("security_id").cast("string"), "cik")).alias("identifier")).distinct()
    return SecurityMaster(m).resolve_batch(ids, "2021-03-01").select("identifier", "security_id", "symbol")


@_case(f"""WITH {_MASTER}, q AS {_DAYS},
e AS (SELECT q.symbol, q.day, arg_min(security_id, epoch(start_date::TIMESTAMP) * 1e5 + security_id) AS security_id FROM q JOIN m ON m.symbol = q.symbol AND q.day BETWEEN start_date AND end_date GROUP BY 1, 2),
n AS (SELECT q.symbol, q.day, arg_min(u.security_id, CASE WHEN q.day < u.start_date THEN date_diff('day', q.day, u.start_date) WHEN q.day > u.end_date THEN date_diff('day', u.end_date, q.day) ELSE 0 END * 1e7 + u.security_id) AS security_id
  FROM q JOIN m u ON u.symbol = q.symbol WHERE EXISTS (SELECT 1 FROM m a WHERE a.security_id = u.security_id AND q.day BETWEEN a.start_date AND a.end_date) GROUP BY 1, 2)
SELECT q.symbol, q.day, coalesce(e.security_id, n.security_id) AS security_id FROM q LEFT JOIN e USING (symbol, day) LEFT JOIN n USING (symbol, day)""")
def master_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols on days, with the nearest use where none is exact."""
    m = master(spark, sf_dir)
    days = F.explode(F.array(*(F.lit(d).cast("date") for d in ("2020-06-15", "2021-03-01", "2022-09-30"))))
    return SecurityMaster(m).security_ids(m.select("symbol").distinct().withColumn("day", days))


@_case(f"WITH {_MASTER} SELECT symbol, security_id, start_date FROM m WHERE DATE '2021-03-01' BETWEEN start_date AND end_date AND (regexp_matches(lower(symbol), '1') OR regexp_matches(lower(company), '1')) ORDER BY symbol, start_date LIMIT 1000000")
def master_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecurityMaster(master(spark, sf_dir)).search("1", "2021-03-01", 1_000_000).select("symbol", "security_id", "start_date")


@_case(f"WITH {_MASTER} SELECT security_id, symbol, min(start_date) AS start_date, max(end_date) AS end_date FROM m GROUP BY ALL")
def master_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecurityMaster(master(spark, sf_dir)).history()


@_case(f"WITH {_MASTER} SELECT security_id, CASE WHEN bool_or(symbol[1] = 'U') THEN 'U' ELSE 'T' END || (security_id % 40)::VARCHAR AS symbol FROM m WHERE start_date <= DATE '2021-12-31' AND end_date >= DATE '2021-01-01' GROUP BY security_id")
def master_in_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecurityMaster(master(spark, sf_dir)).in_years(2021, 2021)


@_case(f"""WITH {_MASTER}, q AS (SELECT DISTINCT symbol, y AS year FROM m CROSS JOIN (VALUES (2020), (2021), (2022)) v(y)),
d AS (SELECT symbol, year, 0 AS p, make_date(year, 12, 31) AS day FROM q UNION ALL SELECT symbol, year, 1, make_date(year, 6, 30) FROM q UNION ALL SELECT symbol, year, 2, make_date(year, 9, 30) FROM q UNION ALL SELECT symbol, year, 3, make_date(year, 3, 31) FROM q),
h AS (SELECT d.symbol, d.year, cik, row_number() OVER (PARTITION BY d.symbol, d.year ORDER BY p, start_date, cik) AS n FROM d JOIN m ON m.symbol = d.symbol AND d.day BETWEEN start_date AND end_date)
SELECT q.symbol, q.year::INT AS year, h.cik FROM q LEFT JOIN h ON h.symbol = q.symbol AND h.year = q.year AND n = 1""")
def master_cik(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = master(spark, sf_dir)
    return SecurityMaster(m).cik_of(m.select("symbol").distinct().withColumn("year", F.explode(F.array(*map(F.lit, (2020, 2021, 2022))))))


@_case("""WITH t AS (SELECT 'A.' || s_suppkey::VARCHAR AS old, CASE WHEN s_suppkey % 7 = 0 THEN 'n' || s_suppkey::VARCHAR WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'a-' || s_suppkey::VARCHAR END AS new, s_suppkey FROM supplier),
a AS (SELECT upper(translate(old, '.-', '')) AS key, old FROM t), b AS (SELECT upper(translate(new, '.-', '')) AS key, new FROM t WHERE new IS NOT NULL)
SELECT coalesce(a.key, b.key) AS key, old, new, CASE WHEN new IS NULL THEN 'disappeared' WHEN old IS NULL THEN 'appeared' ELSE 'active' END AS status FROM a FULL JOIN b ON a.key = b.key""")
def universe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = _read(spark, sf_dir, "supplier")
    now = s.select(F.when(k % 7 == 0, F.concat(F.lit("n"), k.cast("string"))).when(k % 5 == 0, None).otherwise(F.concat(F.lit("a-"), k.cast("string"))).alias("ticker")).filter("ticker IS NOT NULL")
    return universe.changes(s.select(F.concat(F.lit("A."), k.cast("string")).alias("ticker")), now)


_DEBT = " OR ".join(f"contains(n, '{x}')" for x in universe.DEBT)


@_case(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Common Stock' WHEN 1 THEN 'Series A Preferred' WHEN 2 THEN 'Income Trust' WHEN 3 THEN 'Realty Income Trust' WHEN 4 THEN 'Uniti Group' WHEN 5 THEN 'Acme Units' WHEN 6 THEN '5% Notes' WHEN 7 THEN ' ' ELSE NULL END AS n FROM part)
SELECT p_partkey, n AS name, coalesce(trim(n) <> '' AND NOT ({" OR ".join(f"contains(n, '{x}')" for x in universe.EXCLUDED)}) AND NOT regexp_matches(n, '\\b(Units?|Rights?|Warrants?)\\b') AND NOT ((contains(n, 'Trust') OR contains(n, 'Fund')) AND ({_DEBT}) AND NOT (contains(n, 'Realty') OR contains(n, 'Real Estate') OR contains(n, 'REIT'))), false) AS common FROM t""")
def universe_common_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Common Stock", "Series A Preferred", "Income Trust", "Realty Income Trust", "Uniti Group", "Acme Units", "5% Notes", " ")
    p = _read(spark, sf_dir, "part").select("p_partkey", F.try_element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int")).alias("name"))
    return p.withColumn("common", universe.is_common_stock(F.col("name")))


@_case("""WITH f AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_suppkey::VARCHAR AS symbol, avg(round(l_extendedprice) * l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING avg(round(l_extendedprice) * l_quantity) > 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, symbol) AS place FROM f) SELECT month, symbol, round(v, 4) AS avg_dollar_vol, place::INT AS place FROM r WHERE place <= 20""")
def universe_top_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most traded of each month."""
    b = _read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_suppkey").cast("string").alias("symbol"), F.round("l_extendedprice").alias("close"), F.col("l_quantity").alias("volume"))
    return universe.top_by_dollar_volume(b, 20, by="month").withColumn("avg_dollar_vol", F.round("avg_dollar_vol", 4)).withColumn("place", F.col("place").cast("int"))


@_case(f"""WITH RECURSIVE {PANEL_SQL}, d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT p.d AS date, p.s AS symbol, p.close FROM p JOIN d ON d.d = p.d WHERE close IS NOT NULL""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on trading days, which are the days with orders."""
    return _calendar(spark, sf_dir).only(weekly_panel(spark, sf_dir).df.filter("close IS NOT NULL").select("date", "symbol", "close"))


def _calendar(spark: SparkSession, sf_dir: str) -> TradingCalendar:
    return TradingCalendar(_read(spark, sf_dir, "orders").select("o_orderdate"))


@_case("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d AS date, 'year' AS range FROM d WHERE year(d) = 1996 UNION ALL SELECT d, 'month' FROM d WHERE strftime(d, '%Y-%m') = '1996-02'
UNION ALL SELECT d, 'between' FROM d WHERE d BETWEEN DATE '1996-03-05' AND DATE '1996-04-10' UNION ALL (SELECT d, 'last' FROM d WHERE d <= DATE '1996-05-01' ORDER BY d DESC LIMIT 10)""")
def calendar_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range reads of a calendar."""
    c = _calendar(spark, sf_dir)
    parts = {"year": c.of_year(1996), "month": c.of_year(1996, 2), "between": c.between("1996-03-05", "1996-04-10"), "last": c.last_days("1996-05-01", 10)}
    return reduce(DataFrame.unionByName, (df.withColumn("range", F.lit(name)) for name, df in parts.items()))


def _parsed(e: DataFrame) -> DataFrame:
    bar = F.to_json(F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("t"), F.col("value").alias("o"), (F.col("event_id") % 100).alias("v")))
    rows = ticks.parse_bars(e.select("event_id", F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("symbol"), bar.alias("value")))
    return ticks.normal_form(rows).select("event_id", "symbol", "timestamp", "open", "volume")


@_case("""SELECT event_id, 'E' || user_id::VARCHAR AS symbol, strftime((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%dT%H:%M:%S') AS timestamp, round(value, 4) AS open, (event_id % 100)::BIGINT AS volume FROM events""")
def ticks_parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bars to rows in local time, in winter and summer."""
    return _parsed(_read(spark, sf_dir, "events"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual and quarterly figures of customers: orders by year and quarter, filed at its end; a quarter may be missing."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.round("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    quarters = o.groupBy("symbol", "y", "q").agg(F.sum("v").alias("val")).filter("q < 4").select("symbol", "val", "y", F.concat(F.lit("CY"), F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string")).alias("frame"), F.make_date("y", F.col("q") * 3 - 2, F.lit(1)).alias("start"), F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("end"))
    years = o.groupBy("symbol", "y").agg(F.sum("v").alias("val")).select("symbol", "val", "y", F.concat(F.lit("CY"), F.col("y").cast("string")).alias("frame"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"))
    return quarters.unionByName(years).withColumns({"concept": F.lit("sales"), "filed": F.date_add("end", 30), "accn": F.col("frame")}).drop("y")


@_case("""WITH o AS (SELECT o_custkey::VARCHAR AS symbol, round(o_totalprice) AS v, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders),
a AS (SELECT symbol, y, sum(v) AS total, sum(v) FILTER (WHERE q = 1) AS q1, sum(v) FILTER (WHERE q = 2) AS q2, sum(v) FILTER (WHERE q = 3) AS q3 FROM o GROUP BY 1, 2)
SELECT symbol, 'CY' || y::VARCHAR || 'Q1' AS frame, make_date(y, 1, 1) AS start, q1 AS val FROM a WHERE q1 IS NOT NULL UNION ALL SELECT symbol, 'CY' || y::VARCHAR || 'Q2', make_date(y, 4, 1), q2 FROM a WHERE q2 IS NOT NULL
UNION ALL SELECT symbol, 'CY' || y::VARCHAR || 'Q3', make_date(y, 7, 1), q3 FROM a WHERE q3 IS NOT NULL UNION ALL SELECT symbol, 'CY' || y::VARCHAR, make_date(y, 10, 1), total - q1 - q2 - q3 FROM a WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL""")
def fundamentals_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.quarterly(_filings(spark, sf_dir)).select("symbol", "frame", "start", "val")


@_case("""WITH t AS (SELECT o_custkey::VARCHAR AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'tag_a' WHEN 1 THEN 'tag_b' ELSE 'tag_z' END AS tag, round(o_totalprice) AS val, 'CY' || year(o_orderdate)::VARCHAR AS frame FROM orders),
r AS (SELECT symbol, tag, val, frame, row_number() OVER (PARTITION BY symbol, frame ORDER BY tag, val) AS n FROM t WHERE tag <> 'tag_z') SELECT symbol, frame, tag, val FROM r WHERE n = 1""")
def fundamentals_merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.element_at(F.array(*map(F.lit, ("tag_a", "tag_b", "tag_z"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("tag"), F.round("o_totalprice").alias("val"), F.concat(F.lit("CY"), F.year("o_orderdate").cast("string")).alias("frame"))
    facts = o.withColumns({"accn": F.lit("a"), "filed": F.lit("f")})
    return fundamentals.merge_tags(facts, {"sales": ["tag_a", "tag_b"]}).select("symbol", "frame", "tag", "val")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly_panel(spark, sf_dir).df.filter("close IS NOT NULL").withColumn("pos", (F.row_number().over(Window.partitionBy("symbol").orderBy("date_idx")) - 1).cast("int"))
    return p.select("symbol", "pos", (F.col("close") / 1000).alias("ret"), F.col("date").cast("string").alias("date"))


@_case(f"""WITH RECURSIVE {PANEL_SQL}, r AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS pos, close / 1000 AS ret FROM p WHERE close IS NOT NULL), ff AS (SELECT min(s) AS s FROM r),
j AS (SELECT r.s, r.ret AS y, n.ret AS x FROM r JOIN r n ON n.pos = r.pos AND n.s = (SELECT s FROM ff) WHERE r.s <> (SELECT s FROM ff)),
cc AS (SELECT s, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS corr, (s::BIGINT % 5)::DOUBLE - 1 AS sharpe FROM j GROUP BY s)
SELECT s AS version_id, {_r('corr')} AS corr, CASE WHEN sharpe = 0 THEN 'Infinity'::DOUBLE ELSE {_r('(1.5 - sharpe) / sharpe * 100')} END AS improvement, coalesce(corr < 0.7, false) OR sharpe = 0 OR (1.5 - sharpe) / nullif(sharpe, 0) * 100 >= 10 AS passed FROM cc""")
def journal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series against all others."""
    s = _series(spark, sf_dir)
    first = s.agg(F.min("symbol").alias("_first"))
    mine = s.join(F.broadcast(first), F.col("symbol") == F.col("_first")).select("pos", "ret")
    # a series is as long as the calendar
    others = s.join(F.broadcast(first), F.col("symbol") != F.col("_first")).groupBy(F.col("symbol").alias("version_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "date", "ret"))), lambda x: F.struct(x["date"].alias("date"), x["ret"].alias("ret"))).alias("pnl"))
    out = journal.check(mine, 1.5, others.withColumn("sharpe", (F.col("version_id").cast("long") % 5).cast("double") - 1))
    return _rounded(out.select("version_id", "corr", "improvement", "passed"))


@_case("SELECT DISTINCT upper(translate(s_name, '.-#', '')) AS normal, upper(replace(s_name, '.', '-')) AS sec, lpad(s_suppkey::VARCHAR, 10, '0') AS cik FROM supplier")
def ticker_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.select(normal_ticker(F.translate("s_name", "#", "")).alias("normal"), sec_ticker(F.col("s_name")).alias("sec"), padded_cik(F.col("s_suppkey")).alias("cik")).distinct()


@_case("""WITH t AS (SELECT o_custkey AS permno, o_orderkey::VARCHAR AS symbol, o_orderdate::DATE AS start_date, CASE o_orderkey % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', NULL, 'b'] WHEN 2 THEN ['c'] END AS ciks FROM orders),
n AS (SELECT *, lag(permno) OVER w IS NULL OR coalesce(symbol <> lag(symbol) OVER w AND len(lag(ciks) OVER w) > 0 AND len(ciks) > 0 AND NOT list_has_any(lag(ciks) OVER w, ciks), false) AS new FROM t WINDOW w AS (PARTITION BY permno ORDER BY start_date, symbol))
SELECT permno, symbol, (sum(new::INT) OVER (ORDER BY permno, start_date, symbol ROWS UNBOUNDED PRECEDING) + 1000)::BIGINT AS security_id FROM n""")
def master_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by runs of use."""
    ciks = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("a"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("a"), F.lit(None), F.lit("b"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("c")))
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("permno"), F.col("o_orderkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("start_date"), ciks.alias("ciks"))
    return sessions(o).select("permno", "symbol", "security_id")


@_case(f"WITH RECURSIVE {PANEL_SQL} SELECT d AS date, s AS symbol, close - lag(close, 5) OVER {S} AS delta, avg(close) OVER {w(5)} AS mean, close - avg(close) OVER {D} AS apart FROM p")
def compute_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several formulas over one plan."""
    out = compute_all({"delta": "ts_delta(close, 5)", "mean": "ts_mean(close, 5)", "apart": "normalize(close)"}, weekly_panel(spark, sf_dir)).drop("date_idx")
    return out.withColumn("apart", F.when(~F.isnan("apart"), F.col("apart")))


@_case(f"WITH RECURSIVE {PANEL_SQL} SELECT d AS date, s AS symbol, close - lag(close, 5) OVER {S} AS value FROM p QUALIFY i >= 100")
def compute_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula that reads earlier rows of another panel."""
    from tessera.plans.run import compute

    p = weekly_panel(spark, sf_dir).df
    return compute("ts_delta(close, 5)", Panel(p.filter("date_idx >= 100")), lookback=Panel(p.filter("date_idx < 100"))).drop("date_idx")


@_case(None)
def panel_wide_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix: dates by all symbols. Its SQL would have to list the symbols of the table."""
    return weekly_panel(spark, sf_dir).to_wide("volume")


_TAGGED = "t AS (SELECT o_custkey::VARCHAR AS symbol, o_orderkey AS accn, o_orderdate::DATE AS filed, CASE o_orderkey % 4 WHEN 0 THEN 'SalesRevenueNet' WHEN 1 THEN 'AssetsTotal' WHEN 2 THEN 'StatementTable' ELSE 'NetIncomeLoss' END AS tag, o_orderpriority AS label, round(o_totalprice) AS val, year(o_orderdate)::INT AS fy FROM orders)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    tags = F.array(*map(F.lit, ("SalesRevenueNet", "AssetsTotal", "StatementTable", "NetIncomeLoss")))
    return o.select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderkey").alias("accn"), F.col("o_orderdate").cast("date").alias("filed"), F.element_at(tags, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("tag"), F.col("o_orderpriority").alias("label"), F.round("o_totalprice").alias("val"), F.year("o_orderdate").alias("fy"))


@_case(f"WITH {_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, tag ORDER BY filed DESC, fy DESC, val DESC) AS n FROM t) SELECT symbol, tag, val FROM r WHERE n = 1")
def tags_latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.latest_fact(tagged(spark, sf_dir).withColumn("end", F.col("filed")))


@_case(f"WITH {_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filed DESC, accn) AS n FROM t) SELECT symbol, accn, filed FROM r WHERE n <= 3 ORDER BY filed DESC, accn LIMIT 100")
def tags_select_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.select_filings(tagged(spark, sf_dir).select("symbol", "accn", "filed"), 3, 100)


@_case(f"WITH {_TAGGED} SELECT tag, count(DISTINCT accn) AS filings, min(label) AS label FROM t WHERE NOT regexp_matches(lower(tag), '{'|'.join((*tagging.STRUCTURE, *tagging.BREAKDOWN))}') GROUP BY tag")
def tags_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_usage(tagged(spark, sf_dir))


@_case("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.33) AS a, quantile_cont(c_acctbal, 0.66) AS b FROM customer),
t AS (SELECT c_custkey::VARCHAR AS symbol, c_acctbal AS size, c_mktsegment AS industry, (CASE WHEN c_acctbal <= a THEN 0 WHEN c_acctbal <= b THEN 1 ELSE 2 END)::INT AS tier FROM customer, q),
r AS (SELECT *, row_number() OVER (PARTITION BY tier, industry ORDER BY md5('7:' || symbol), symbol)::INT AS turn FROM t) SELECT * FROM r ORDER BY turn, tier, industry, symbol LIMIT 60""")
def tags_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty companies in turn from strata of size and industry."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_acctbal").alias("size"), F.col("c_mktsegment").alias("industry"))
    return tagging.stratified_sample(c, 60)


@_case(None)
def tags_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = spark.createDataFrame([("sales", "Sales revenue net"), ("income", "Net income or loss"), ("assets", "Assets total")], "concept string, description string")
    u = tagging.tag_usage(tagged(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, ("Sales Revenue, Net", "Assets, Total", "Table", "Net Income (Loss)"))), (F.col("accn") % 4 + 1).cast("int"))))
    return tagging.suggest(concepts, u)


def _name_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names: orders, as uses of symbols by customers; links of identifiers: suppliers; a regulator's listing: parts."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    cusip = F.concat(F.lpad((c % 90).cast("string"), 6, "0"), F.lpad((k % 3).cast("string"), 2, "0"), F.lit("X"))
    names = _read(spark, sf_dir, "orders").select(c.alias("permno"), F.when(k % 11 != 0, F.concat(F.lit("S"), (k % 7).cast("string"))).alias("symbol"), F.concat(F.lit("c"), (c % 5).cast("string")).alias("company"), F.when(k % 13 != 0, cusip).alias("cusip"), d.alias("start_date"), F.date_add(d, (k % 400).cast("int")).alias("end_date"))
    s = F.col("s_suppkey")
    links = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lpad((s % 80).cast("string"), 6, "0"), F.lpad((s % 3).cast("string"), 2, "0"), F.lit("YY")).alias("cusip"), F.when(s % 9 != 0, padded_cik(s)).alias("cik"),
        F.date_add(F.lit("1992-01-01").cast("date"), (s * 37 % 900).cast("int")).alias("cik_from"), F.date_add(F.lit("1992-01-01").cast("date"), (s * 37 % 900 + s * 53 % 1500).cast("int")).alias("cik_to"),
    )
    p = F.col("p_partkey")
    listing = _read(spark, sf_dir, "part").select(F.concat(F.lit("s."), (p % 5).cast("string")).alias("ticker"), (p * 1000).alias("cik_str"))
    return names, links, listing


_NAMES = """
n AS (SELECT o_custkey AS permno, CASE WHEN o_orderkey % 11 <> 0 THEN 'S' || (o_orderkey % 7)::VARCHAR END AS symbol, 'c' || (o_custkey % 5)::VARCHAR AS company,
  CASE WHEN o_orderkey % 13 <> 0 THEN lpad((o_custkey % 90)::VARCHAR, 6, '0') || lpad((o_orderkey % 3)::VARCHAR, 2, '0') || 'X' END AS cusip, o_orderdate::DATE AS start_date, o_orderdate::DATE + (o_orderkey % 400)::INT AS end_date FROM orders),
k AS (SELECT lpad((s_suppkey % 80)::VARCHAR, 6, '0') || lpad((s_suppkey % 3)::VARCHAR, 2, '0') AS c8, CASE WHEN s_suppkey % 9 <> 0 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS cik,
  DATE '1992-01-01' + (s_suppkey * 37 % 900)::INT AS cik_from, DATE '1992-01-01' + (s_suppkey * 37 % 900 + s_suppkey * 53 % 1500)::INT AS cik_to FROM supplier),
j AS (SELECT n.*, k.cik, row_number() OVER (PARTITION BY permno, symbol, start_date, end_date ORDER BY coalesce(date_diff('day', cik_from, cik_to), -1) DESC, k.cik NULLS LAST, company NULLS LAST, cusip NULLS LAST) AS place
  FROM n LEFT JOIN k ON n.cusip[1:8] = k.c8 AND (k.cik IS NULL OR start_date <= cik_to) AND (k.cik IS NULL OR end_date >= cik_from)),
r AS (SELECT permno, symbol, company, cik, cusip, min(start_date) AS start_date, max(end_date) AS end_date FROM j WHERE place = 1 AND symbol IS NOT NULL GROUP BY permno, symbol, company, cik, cusip),
h AS (SELECT 'S' || (p_partkey % 5)::VARCHAR AS ticker, min(lpad((p_partkey * 1000)::VARCHAR, 10, '0')) AS cik FROM part WHERE p_partkey <> 0 GROUP BY 1),
q AS (SELECT r.* REPLACE (coalesce(r.cik, h.cik) AS cik) FROM r LEFT JOIN h ON h.ticker = r.symbol),
u AS (SELECT permno, symbol, list_sort(coalesce(list(DISTINCT cik) FILTER (WHERE cik IS NOT NULL), [])) AS ciks, min(start_date) AS start_date, max(end_date) AS end_date FROM q GROUP BY permno, symbol),
b AS (SELECT *, lag(permno) OVER o IS NULL OR coalesce(symbol <> lag(symbol) OVER o AND len(lag(ciks) OVER o) > 0 AND len(ciks) > 0 AND NOT list_has_any(lag(ciks) OVER o, ciks), false) AS new FROM u WINDOW o AS (PARTITION BY permno ORDER BY start_date, symbol)),
i AS (SELECT permno, symbol, (sum(new::INT) OVER (ORDER BY permno, start_date, symbol ROWS UNBOUNDED PRECEDING) + 1000)::BIGINT AS security_id FROM b)"""


@_case(f"WITH {_NAMES} SELECT * FROM r")
def master_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name records with their most reliable CIK, joined by identifier and time."""
    names, links, _ = _name_records(spark, sf_dir)
    return master_build.periods(names, links)


@_case(f"WITH {_NAMES} SELECT * FROM q")
def master_fill_ciks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing CIKs from a listing."""
    names, links, listing = _name_records(spark, sf_dir)
    return master_build.fill_ciks(master_build.periods(names, links), master_build.listed_ciks(listing))


@_case(f"WITH {_NAMES} SELECT permno, symbol, array_to_string(ciks, ',') AS ciks, start_date, end_date FROM u")
def master_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of symbols, with all known CIKs."""
    return master_build.uses(master_fill_ciks(spark, sf_dir)).select("permno", "symbol", F.array_join("ciks", ",").alias("ciks"), "start_date", "end_date")


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Securities and companies: customers; names of codes: nations."""
    c = F.col("c_custkey")
    t = _read(spark, sf_dir, "customer")
    securities = t.select(c.alias("gvkey"), F.when(c % 17 != 0, F.concat(F.lpad((c % 70).cast("string"), 6, "0"), F.lit("zz"))).alias("cusip"), (c % 20).alias("exchg"))
    companies = t.filter(c % 3 != 0).select(c.alias("gvkey"), (c % 27).alias("gsector"), (c % 31).alias("ggroup"), (c % 23).alias("gsubind"))
    n = _read(spark, sf_dir, "nation")
    return securities, companies, n.select(F.explode(F.array(*map(F.lit, master_build.LABELS))).alias("kind"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))


_LABELLED = """
e AS (SELECT c_custkey AS gvkey, lpad((c_custkey % 70)::VARCHAR, 6, '0') AS cusip6, x.n_name AS exchange, a.n_name AS sector, g.n_name AS industry, z.n_name AS subindustry, row_number() OVER (PARTITION BY c_custkey % 70 ORDER BY c_custkey) AS n
  FROM customer LEFT JOIN nation x ON x.n_nationkey = c_custkey % 20 LEFT JOIN nation a ON a.n_nationkey = c_custkey % 27 LEFT JOIN nation g ON g.n_nationkey = c_custkey % 31 LEFT JOIN nation z ON z.n_nationkey = c_custkey % 23
  WHERE c_custkey % 17 <> 0 AND c_custkey % 3 <> 0)"""


@_case(f"WITH {_NAMES}, {_LABELLED} SELECT security_id, q.permno, q.symbol, company, cik, start_date, end_date, exchange, sector, industry, subindustry FROM q JOIN i ON i.permno = q.permno AND i.symbol = q.symbol LEFT JOIN e ON e.cusip6 = q.cusip[1:6] AND e.n = 1")
def master_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole master from names, links, a listing and classifications."""
    return master_build.build(*_name_records(spark, sf_dir), *_codes(spark, sf_dir))


@_case(f"WITH {_NAMES}, {_LABELLED} SELECT sector, count(*) AS len FROM q LEFT JOIN e ON e.cusip6 = q.cusip[1:6] AND e.n = 1 WHERE sector IS NOT NULL GROUP BY sector")
def master_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the master each sector has."""
    return master_build.histogram(master_built(spark, sf_dir), "sector", known=True)


@_case(f"""WITH {_MASTER}, l AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 't.' ELSE 'U-' END || (s_suppkey % 30)::VARCHAR AS ticker FROM supplier),
g AS (SELECT upper(translate(ticker, '.-', '')) AS key, min(ticker) AS ticker FROM l GROUP BY 1), q AS {_DAYS},
v AS (SELECT symbol, day, (SELECT arg_min(security_id, epoch(start_date::TIMESTAMP) * 1e5 + security_id) FROM m WHERE m.symbol = q.symbol AND q.day BETWEEN start_date AND end_date) AS a,
  (SELECT arg_min(security_id, epoch(start_date::TIMESTAMP) * 1e5 + security_id) FROM m WHERE m.symbol = q.symbol AND DATE '2021-06-01' BETWEEN start_date AND end_date) AS b FROM q)
SELECT v.symbol, v.day, CASE WHEN g.ticker IS NOT NULL AND a = b THEN g.ticker ELSE upper(v.symbol) END AS form FROM v LEFT JOIN g ON g.key = v.symbol""")
def master_listed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a day as the listing writes them, where the security is the same."""
    m = master(spark, sf_dir)
    k = F.col("s_suppkey")
    listing = _read(spark, sf_dir, "supplier").select(F.concat(F.when(k % 2 == 0, "t.").otherwise("U-"), (k % 30).cast("string")).alias("ticker"))
    days = F.explode(F.array(*(F.lit(d).cast("date") for d in ("2020-06-15", "2021-03-01", "2022-09-30"))))
    return master_build.listed_form(m.select("symbol").distinct().withColumn("day", days), listing, SecurityMaster(m), "2021-06-01")


@_case(f"WITH {_MASTER}, a AS (SELECT DISTINCT security_id, DATE '2020-12-01' AS day FROM m) SELECT a.security_id, a.day, arg_min(m.symbol, m.start_date) AS symbol FROM a LEFT JOIN m ON m.security_id = a.security_id AND a.day BETWEEN start_date AND end_date GROUP BY ALL")
def master_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of the master by security and day."""
    m = master(spark, sf_dir)
    return master_build.info(SecurityMaster(m), m.select("security_id", F.lit("2020-12-01").alias("day")), "symbol")
