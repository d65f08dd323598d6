"""Securities through time: which security an identifier meant on a day.

The master holds a row for each symbol that a security has had: security_id, symbol, company, cik, start_date, end_date
(null: open). Masters are small beside facts, but nothing here assumes so: batches are joins, and Spark picks how."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.plans.errors import SecurityNotFoundError


def normal_ticker(c: Column) -> Column:
    """Without separators, upper case: BRK.B and BRK-B are BRKB."""
    return F.upper(F.translate(c, ".-", ""))


def sec_ticker(c: Column) -> Column:
    """Dots as hyphens, upper case."""
    return F.upper(F.translate(c, ".", "-"))


def padded_cik(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


class SecurityMaster:
    KEYS = ("symbol", "security_id", "cik")

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @staticmethod
    def valid(day: Column, open_end: bool = True) -> Column:
        """start_date <= day <= end_date; an open end counts only if open_end."""
        ends = F.col("end_date") >= day
        return (F.col("start_date") <= day) & (F.coalesce(ends, F.lit(True)) if open_end else ends)

    def resolve_batch(self, identifiers: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
        """identifier and the columns of the master, null if it resolves to none, for each of identifiers (identifier).

        Symbols come before security ids, those before CIKs. An identifier that matches a single row of a kind needs no date
        unless as_of is given; of several rows, that valid on as_of (default: yesterday) counts, the earliest if several are."""
        day = F.lit(as_of).cast("date") if as_of is not None else F.date_sub(F.current_date(), 1)
        wanted = identifiers.select(F.col("identifier").cast("string").alias("identifier")).distinct()
        found: DataFrame | None = None
        for place, key in enumerate(k for k in self.KEYS if k in self.rows.columns):
            hit = wanted.join(self.rows.withColumn("_key", F.col(key).cast("string")), F.col("identifier") == F.col("_key")).drop("_key").withColumn("_place", F.lit(place))
            found = hit if found is None else found.unionByName(hit)
        alone = F.count("*").over(Window.partitionBy("identifier", "_place")) == 1
        keep = self.valid(day) if as_of is not None else alone | self.valid(day)
        first = Window.partitionBy("identifier").orderBy("_place", "start_date", F.col("security_id").cast("string"))
        found = found.withColumn("_keep", keep).filter("_keep").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_keep", "_n", "_place")
        return wanted.join(found, "identifier", "left")

    def resolve(self, identifier: str, as_of: dt.date | str | None = None) -> Row | None:
        df = self.rows.sparkSession.createDataFrame([(str(identifier),)], "identifier string")
        r = self.resolve_batch(df, as_of).first()
        return None if r is None or r["start_date"] is None and r["security_id"] is None else r

    def by_security_id(self, security_id) -> Row | None:
        return self.rows.filter(F.col("security_id") == F.lit(security_id)).orderBy("start_date").first()

    def search(self, text: str, as_of: dt.date | str | None = None, limit: int = 10) -> DataFrame:
        """Rows valid on as_of whose symbol or company matches text, a lower-cased regular expression."""
        day = F.lit(as_of).cast("date") if as_of is not None else F.date_sub(F.current_date(), 1)
        q = text.lower()
        return self.rows.filter(self.valid(day) & (F.lower("symbol").rlike(q) | F.lower("company").rlike(q))).orderBy("symbol", "start_date").limit(limit)

    def in_years(self, start: int, end: int) -> DataFrame:
        """symbol, security_id of the securities active in these years, each by its latest symbol."""
        active = self.rows.filter((F.col("start_date") <= F.lit(f"{end}-12-31").cast("date")) & (F.col("end_date") >= F.lit(f"{start}-01-01").cast("date")))
        latest = F.max_by("symbol", F.struct("end_date", "start_date", "symbol"))
        return active.groupBy("security_id").agg(latest.alias("symbol")).select("symbol", "security_id").orderBy("security_id")

    def history(self, security_id=None) -> DataFrame:
        """security_id, symbol, first start and last end."""
        rows = self.rows if security_id is None else self.rows.filter(F.col("security_id") == F.lit(security_id))
        return rows.groupBy("security_id", "symbol").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))

    def security_ids(self, usage: DataFrame, auto_resolve: bool = True) -> DataFrame:
        """security_id for each of usage (symbol, day): that whose symbol it was that day; else, if auto_resolve, of the
        securities that ever had the symbol and were active that day under any, the one that used it nearest; else null."""
        wanted = usage.select("symbol", F.col("day").cast("date").alias("day")).distinct()
        rows = self.rows.filter("security_id IS NOT NULL").select("security_id", F.col("symbol").alias("_s"), "start_date", "end_date")
        exact = wanted.join(rows, (F.col("symbol") == F.col("_s")) & self.valid(F.col("day"), open_end=False))
        exact = exact.groupBy("symbol", "day").agg(F.min_by("security_id", F.struct("start_date", "security_id")).alias("security_id"))
        if not auto_resolve:
            return wanted.join(exact, ["symbol", "day"], "left")
        rest = wanted.join(exact, ["symbol", "day"], "left_anti")
        used = rows.groupBy("_s", "security_id").agg(F.min("start_date").alias("used_from"), F.min_by("end_date", "start_date").alias("used_to"))
        near = rest.join(used, F.col("symbol") == F.col("_s")).drop("_s")
        active = rows.select(F.col("security_id").alias("_id"), "start_date", "end_date")
        near = near.join(active, (F.col("security_id") == F.col("_id")) & self.valid(F.col("day"), open_end=False), "left_semi")
        gap = F.when(F.col("day") < F.col("used_from"), F.datediff("used_from", "day")).when(F.col("day") > F.col("used_to"), F.datediff("day", "used_to")).otherwise(0)
        near = near.groupBy("symbol", "day").agg(F.min_by("security_id", F.struct(gap, "security_id")).alias("security_id"))
        return wanted.join(exact.unionByName(near), ["symbol", "day"], "left")

    def security_id(self, symbol: str, day: dt.date | str, auto_resolve: bool = True):
        df = self.rows.sparkSession.createDataFrame([(symbol, str(day))], "symbol string, day string")
        r = self.security_ids(df, auto_resolve).first()
        if r is None or r["security_id"] is None:
            raise SecurityNotFoundError(f"{symbol} on {day}")
        return r["security_id"]

    def cik_of(self, usage: DataFrame) -> DataFrame:
        """symbol, year, cik: the security's on the last day of the year, else mid-year, else a quarter's end; first hit wins."""
        ends = F.array(*(F.concat_ws("-", F.col("year").cast("string"), F.lit(d)).cast("date") for d in ("12-31", "06-30", "09-30", "03-31")))
        days = usage.select("symbol", "year", F.posexplode(ends).alias("place", "day"))
        rows = self.rows.filter("cik IS NOT NULL").select(F.col("symbol").alias("_s"), "cik", "start_date", "end_date")
        hit = days.join(rows, (F.col("symbol") == F.col("_s")) & self.valid(F.col("day"), open_end=False))
        return usage.join(hit.groupBy("symbol", "year").agg(F.min_by("cik", F.struct("place", "start_date", "cik")).alias("cik")), ["symbol", "year"], "left")

    def update(self, before: DataFrame, now: DataFrame, figi: DataFrame, today: dt.date | str, days_since: int, current_from: dt.date | str, grace_days: int = 14) -> DataFrame:
        """The master after a day's listing. before, now: universes (ticker); figi: ticker, figi of those that changed.

        Rows of tickers still listed get the listed form, and if they end on current_from or later, today as their end. A ticker that
        went while one of the same FIGI came is a new name: its row ends, and a row with the same security_id starts.
        Other missing tickers are kept open for grace_days. New tickers get new ids, in order of ticker."""
        from tessera.sources.universe import changes

        day = F.lit(today).cast("date")
        diff = changes(before, now)
        ids = figi.filter("figi IS NOT NULL").select(normal_ticker(F.col("ticker")).alias("key"), "figi").dropDuplicates(["key"])
        gone = diff.filter("status = 'disappeared'").join(ids, "key").groupBy("figi").agg(F.min("key").alias("old_key"))
        came = diff.filter("status = 'appeared'").join(ids, "key").select("figi", F.col("key").alias("new_key"), "new")
        renamed = came.join(gone, "figi").groupBy("new_key").agg(F.min("old_key").alias("old_key"), F.first("new").alias("new"), F.first("figi").alias("figi"))
        rows = self.rows.withColumn("key", normal_ticker(F.col("symbol")))
        state = diff.select("key", "status", F.col("new").alias("_new")).join(renamed.select(F.col("old_key").alias("key"), F.lit(True).alias("renamed")).distinct(), "key", "left")
        rows = rows.join(state, "key", "left")
        extend = (F.col("status") == "active") & (F.col("end_date") >= F.lit(current_from).cast("date"))
        wait = (F.col("status") == "disappeared") & F.col("renamed").isNull() & F.lit(days_since < grace_days)
        rows = rows.withColumn("end_date", F.when(extend | wait, day).otherwise(F.col("end_date"))).withColumn("symbol", F.coalesce("_new", "symbol")).select(*self.rows.columns)
        blank = {c: F.lit(None).cast(t) for c, t in self.rows.dtypes}
        old = self.rows.withColumn("old_key", normal_ticker(F.col("symbol"))).groupBy("old_key").agg(*(F.max_by(c, F.struct("end_date", "start_date")).alias(c) for c in self.rows.columns))
        names = renamed.join(old.withColumnRenamed("old_key", "_k"), F.col("old_key") == F.col("_k"))
        names = names.select(*((F.col("new") if c == "symbol" else day if c in ("start_date", "end_date") else F.col(c)).alias(c) for c in self.rows.columns))
        fresh = diff.filter("status = 'appeared'").join(renamed.select(F.col("new_key").alias("key")), "key", "left_anti")
        # one row for each new listing of a day
        last = self.rows.agg(F.coalesce(F.max(F.col("security_id").cast("long")), F.lit(0)).alias("last"))
        fresh = fresh.withColumn("n", F.row_number().over(Window.orderBy("key"))).crossJoin(F.broadcast(last))
        made = {**blank, "symbol": F.col("new"), "start_date": day, "end_date": day, "security_id": (F.col("last") + F.col("n")).cast(dict(self.rows.dtypes)["security_id"])}
        return rows.unionByName(names).unionByName(fresh.select(*(made[c].alias(c) for c in self.rows.columns)))


def sessions(rows: DataFrame, first: int = 1000) -> DataFrame:
    """Adds security_id to rows (permno, symbol, ciks, start_date): a new one for each permno, and where its symbol changes while
    the CIKs known before and after have none in common; unknown CIKs do not part a security.

    The running number passes one task, with a row for each use of a symbol, not for facts."""
    before = Window.partitionBy("permno").orderBy("start_date", "symbol")
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    old, now = known(F.lag("ciks").over(before)), known(F.col("ciks"))
    parted = F.coalesce((F.size(old) > 0) & (F.size(now) > 0) & ~F.arrays_overlap(old, now), F.lit(False))
    new = F.lag("permno").over(before).isNull() | (F.col("symbol") != F.lag("symbol").over(before)) & parted
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    return rows.withColumn("security_id", F.sum("_new").over(Window.orderBy("permno", "start_date", "symbol").rowsBetween(Window.unboundedPreceding, 0)) + first).drop("_new")
