"""Daily price bars: parsing, normal form, upsert by year, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import Storage

BAR = "struct<t: string, o: double, h: double, l: double, c: double, v: bigint, n: bigint, vw: double>"
COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")


def parse_bars(json: DataFrame, column: str = "value", zone: str = "America/New_York") -> DataFrame:
    """Rows of JSON bars (t, o, h, l, c, v, n, vw; t in UTC) with local time without zone."""
    b = F.from_json(F.col(column), BAR)
    local = F.from_utc_timestamp(F.to_timestamp(F.regexp_replace(b["t"], "Z$", "+00:00")), zone)
    return json.withColumn("_b", b).select(
        *(c for c in json.columns if c != column), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        b["o"].alias("open"), b["h"].alias("high"), b["l"].alias("low"), b["c"].alias("close"), b["v"].alias("volume"), b["n"].alias("num_trades"), b["vw"].alias("vwap"),
    )


def normal_form(df: DataFrame) -> DataFrame:
    """The six columns, prices to four places; columns that are missing are null."""
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None))
    rest = [c for c in df.columns if c not in COLUMNS]
    price = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return df.select(*rest, F.col("timestamp").cast("string").alias("timestamp"), *(price(c) for c in COLUMNS[1:5]), F.col("volume").cast("bigint").alias("volume"))


class Ticks:
    """A table of bars partitioned by year, each row with a security_id."""

    def __init__(self, storage: Storage, name: str = "ticks"):
        self.storage, self.name = storage, name

    def publish(self, bars: DataFrame, start_year: int, end_year: int) -> None:
        """Replaces the years from start_year to end_year of the securities in bars; all else stays.

        Only the partitions of those years are rewritten, each by the commit protocol as a whole."""
        new = normal_form(bars).withColumn("year", F.substring("timestamp", 1, 4).cast("int")).filter(F.col("year").between(start_year, end_year))
        out = new
        if self.storage.exists(self.name):
            old = self.storage.scan_parquet(self.name).filter(F.col("year").between(start_year, end_year))
            out = old.join(bars.select("security_id").distinct(), "security_id", "left_anti").unionByName(new)
        out = out.repartition("year", "security_id").sortWithinPartitions("security_id", "timestamp")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(self.storage.path(self.name))

    def history(self, security_ids: list | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars of some securities between two days; years outside are not read."""
        df = self.storage.scan_parquet(self.name)
        if start:
            df = df.filter((F.col("year") >= int(start[:4])) & (F.col("timestamp") >= start))
        if end:
            # a timestamp of the last day may carry a time
            df = df.filter((F.col("year") <= int(end[:4])) & (F.substring("timestamp", 1, 10) <= end))
        if security_ids is not None:
            df = df.filter(F.col("security_id").isin(list(security_ids)))
        return df.drop("year")

    def has_year(self, security_id, year: int) -> bool:
        if not self.storage.exists(self.name):
            return False
        return not self.storage.scan_parquet(self.name).filter((F.col("year") == year) & (F.col("security_id") == security_id)).isEmpty()

    def missing(self, wanted: DataFrame, year: int) -> DataFrame:
        """The rows of wanted (security_id) without bars in year."""
        if not self.storage.exists(self.name):
            return wanted
        have = self.storage.scan_parquet(self.name).filter(F.col("year") == year).select("security_id").distinct()
        return wanted.join(have, "security_id", "left_anti")
