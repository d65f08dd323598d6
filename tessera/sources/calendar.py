"""Trading days: a table of one column, date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TradingCalendar:
    def __init__(self, days: DataFrame):
        self.days = days.select(F.col(days.columns[0]).cast("date").alias("date")).distinct()

    def between(self, start: dt.date | str, end: dt.date | str) -> DataFrame:
        """Trading days from start to end, both included, in order."""
        return self.days.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date")

    def of_year(self, year: int, month: int | None = None) -> DataFrame:
        if month is None:
            return self.between(dt.date(year, 1, 1), dt.date(year, 12, 31))
        first = dt.date(year, month, 1)
        return self.between(first, (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1))

    def is_trading_day(self, day: dt.date | str) -> bool:
        return not self.days.filter(F.col("date") == F.lit(day).cast("date")).isEmpty()

    def only(self, df: DataFrame, column: str = "date") -> DataFrame:
        """The rows of df on trading days."""
        return df.join(self.days.withColumnRenamed("date", column), column, "left_semi")

    def last_days(self, end: dt.date | str, n: int) -> DataFrame:
        """The n trading days up to end."""
        return self.days.filter(F.col("date") <= F.lit(end).cast("date")).orderBy(F.col("date").desc()).limit(n)
