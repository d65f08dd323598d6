"""Universes: which names are common stock, and the most traded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a security's name that rule it out, whole words that do, and those of funds, debt and real estate.
EXCLUDED = (
    "Preferred",
    "Preference",
    "Pfd Ser",
    "Series",
    "Subordinate",
    "Notes",
    "Limited Partner",
    "Beneficial Interest",
    "Cmn Shs of BI",
    "Closed End Fund",
    "Depositary Share",
    "Depositary Receipt",
    "Redeemable",
    "Perpetual",
    "Convertible",
    "ADS",
    "ADR",
    "ETN",
    "%",
)
EXCLUDED_WORDS = r"\b(Units?|Rights?|Warrants?)\b"
FUND = ("Trust", "Fund")
DEBT = ("Income", "Municipal", "Bond", "Term", "Securities", "Premium", "Rate", "Yield")
REAL_ESTATE = ("Realty", "Real Estate", "REIT")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(x) for x in words))


def is_common_stock(name: Column) -> Column:
    """Whether a security of this name is common stock; false for null and blank names."""
    fund_debt = _any(name, FUND) & _any(name, DEBT) & ~_any(name, REAL_ESTATE)
    return F.coalesce((F.trim(name) != "") & ~_any(name, EXCLUDED) & ~name.rlike(EXCLUDED_WORDS) & ~fund_debt, F.lit(False))


def listed_stocks(listing: DataFrame) -> DataFrame:
    """Ticker, Name of the common stocks of a listing (Ticker, Name and, where there, ETF, `Test Issue`), one row a ticker:
    that of the smallest name. The source has no order of its own."""
    for c in ("ETF", "Test Issue"):
        if c in listing.columns:
            listing = listing.filter(F.col(c) == "N")
    out = listing.filter(is_common_stock(F.col("Name")) & ~F.col("Ticker").contains("$"))
    return out.groupBy("Ticker").agg(F.min("Name").alias("Name")).orderBy("Ticker")


def top_by_dollar_volume(bars: DataFrame, n: int = 3000, least: float = 1000.0, by: str | None = None) -> DataFrame:
    """The n symbols of greatest mean of close * volume over bars (symbol, close, volume), above least; for each value of
    by, if given (say a month). Equal volumes go by symbol."""
    keys = [by] if by else []
    means = bars.groupBy(*keys, "symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_vol")).filter(F.col("avg_dollar_vol") > least)
    order = (F.col("avg_dollar_vol").desc(), F.col("symbol"))
    if not by:
        return means.orderBy(*order).limit(n)
    return means.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """ticker, status (active, disappeared, appeared) of two universes (ticker), compared by normal form."""
    from tessera.sources.security_master import normal_ticker

    a = before.select(normal_ticker(F.col("ticker")).alias("key"), F.col("ticker").alias("old")).dropDuplicates(["key"])
    b = now.select(normal_ticker(F.col("ticker")).alias("key"), F.col("ticker").alias("new")).dropDuplicates(["key"])
    status = F.when(F.col("new").isNull(), "disappeared").when(F.col("old").isNull(), "appeared").otherwise("active")
    return a.join(b, "key", "full_outer").select("key", "old", "new", status.alias("status"))
