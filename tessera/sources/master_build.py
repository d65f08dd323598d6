"""Building a security master: name records, identifier links, classifications, joined into one row per use of a symbol.

Inputs are tables of any size; every step is an equi-join or an aggregation with partial results, so Spark picks how."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.security_master import SecurityMaster, normal_ticker, padded_cik, sessions

LABELS = ("exchange", "sector", "industry", "subindustry")


def link_ciks(names: DataFrame, links: DataFrame) -> DataFrame:
    """Every row of names (permno, symbol, company, cusip, start_date, end_date) with each of links (cusip, cik, cik_from,
    cik_to) of the same first eight characters whose time overlaps it, or with nulls where there is none. A link without a
    cik overlaps all; one without both dates none."""
    known = links.select(F.substring("cusip", 1, 8).alias("_cusip"), "cik", "cik_from", "cik_to")
    meets = (F.col("start_date") <= F.col("cik_to")) & (F.col("end_date") >= F.col("cik_from"))
    on = (F.substring("cusip", 1, 8) == F.col("_cusip")) & (F.col("cik").isNull() | meets)
    return names.join(known, on, "left").drop("_cusip")


def periods(names: DataFrame, links: DataFrame) -> DataFrame:
    """permno, symbol, company, cik, cusip, start_date, end_date: a row for each combination of the first five.

    Of several links of one name record that of the longest time counts, unknown times last; of equally long ones the
    smallest cik. Null keys are values of their own; rows without a symbol go."""
    linked = link_ciks(names, links).withColumn("_days", F.coalesce(F.datediff("cik_to", "cik_from"), F.lit(-1)))
    value = F.struct("cik", "company", "cusip")
    order = F.struct(-F.col("_days"), F.col("cik").isNull(), "cik", F.col("company").isNull(), "company", F.col("cusip").isNull(), "cusip")
    best = linked.groupBy("permno", "symbol", "start_date", "end_date").agg(F.min_by(value, order).alias("_v")).select("permno", "symbol", "start_date", "end_date", "_v.*")
    out = best.filter("symbol IS NOT NULL").groupBy("permno", "cik", "symbol", "company", "cusip").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    return out.select("permno", "symbol", "company", "cik", "cusip", "start_date", "end_date")


def listed_ciks(listing: DataFrame) -> DataFrame:
    """ticker, cik of a regulator's listing (ticker, cik_str): tickers without separators, ciks of ten digits; the smallest
    of several ciks of a ticker. Empty tickers and ciks go."""
    rows = listing.select(normal_ticker(F.col("ticker")).alias("ticker"), padded_cik(F.col("cik_str")).alias("cik")).filter("ticker <> '' AND cik <> '0000000000'")
    return rows.groupBy("ticker").agg(F.min("cik").alias("cik"))


def fill_ciks(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with a null cik taken from listed (ticker, cik; a row a ticker) by symbol."""
    found = rows.join(listed.select(F.col("ticker").alias("symbol"), F.col("cik").alias("_cik")), "symbol", "left")
    return found.withColumn("cik", F.coalesce("cik", "_cik")).select(*rows.columns)


def uses(rows: DataFrame) -> DataFrame:
    """permno, symbol, ciks (known ones, sorted), start_date, end_date, company, cusip: a row for each use of a symbol;
    company and cusip are of its earliest row."""
    early = F.struct("start_date", "end_date", F.col("cik").isNull(), "cik", "company", "cusip")
    out = rows.groupBy("permno", "symbol").agg(F.array_sort(F.collect_set("cik")).alias("ciks"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.min_by(F.struct("company", "cusip"), early).alias("_v"))
    return out.select("permno", "symbol", "ciks", "start_date", "end_date", "_v.*")


def assign_ids(rows: DataFrame, first: int = 1000) -> DataFrame:
    """rows (permno, symbol, cik, dates and more) with security_id, by sessions() over the uses of symbols."""
    ids = sessions(uses(rows), first).select("permno", "symbol", "security_id")
    return rows.join(ids, ["permno", "symbol"], "left").select("security_id", *rows.columns)


def classifications(securities: DataFrame, companies: DataFrame, names: DataFrame) -> DataFrame:
    """cusip6, exchange, sector, industry, subindustry from securities (gvkey, cusip, exchg) and companies (gvkey, gsector,
    ggroup, gsubind). names (kind, code, name) names the codes, a few hundred rows; codes without a name are null. Of several
    companies of a cusip6 the smallest gvkey counts."""
    rows = securities.filter("cusip IS NOT NULL").join(companies, "gvkey").select("gvkey", F.substring("cusip", 1, 6).alias("cusip6"), *(F.col(c).cast("string").alias(k) for c, k in zip(("exchg", "gsector", "ggroup", "gsubind"), LABELS, strict=True))).distinct()
    for kind in LABELS:
        named = names.filter(F.col("kind") == kind).select(F.col("code").cast("string").alias(kind), F.col("name").alias("_name"))
        rows = rows.join(F.broadcast(named), kind, "left").withColumn(kind, F.col("_name")).drop("_name")
    order = F.struct("gvkey", *(x for k in LABELS for x in (F.col(k).isNull(), k)))
    return rows.groupBy("cusip6").agg(F.min_by(F.struct(*LABELS), order).alias("_v")).select("cusip6", "_v.*")


def classify(master: DataFrame, labels: DataFrame) -> DataFrame:
    """master (with cusip) and the labels (cusip6 and LABELS) of its first six characters, null where there are none."""
    return master.withColumn("cusip6", F.substring("cusip", 1, 6)).join(labels, "cusip6", "left").drop("cusip6")


def to_gics(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows (sector_name, industry_name and more) with sector, industry, subindustry by mapping (level, name, sector, industry,
    subindustry): that of the industry's name, else the sector of the sector's name, else nulls. A level has a row a name."""
    of = lambda level, key, *cols: mapping.filter(F.col("level") == level).select(F.col("name").alias(key), *(F.col(c).alias(f"_{level}_{c}") for c in cols))
    out = rows.join(F.broadcast(of("industry", "industry_name", "sector", "industry", "subindustry").withColumn("_hit", F.lit(True))), "industry_name", "left")
    out = out.join(F.broadcast(of("sector", "sector_name", "sector")), "sector_name", "left")
    sector = F.when(F.col("_hit"), F.col("_industry_sector")).otherwise(F.col("_sector_sector"))
    return out.select(*rows.columns, sector.alias("sector"), F.col("_industry_industry").alias("industry"), F.col("_industry_subindustry").alias("subindustry"))


def histogram(rows: DataFrame, column: str, known: bool = False) -> DataFrame:
    """column, len: rows of each value, most first, then by value; only non-null ones if known."""
    rows = rows.filter(F.col(column).isNotNull()) if known else rows
    return rows.groupBy(column).agg(F.count("*").alias("len")).orderBy(F.col("len").desc(), column)


def build(names: DataFrame, links: DataFrame, listing: DataFrame, securities: DataFrame, companies: DataFrame, codes: DataFrame) -> DataFrame:
    """The whole master: security_id, permno, symbol, company, cik, start_date, end_date and LABELS."""
    rows = assign_ids(fill_ciks(periods(names, links), listed_ciks(listing)))
    return classify(rows, classifications(securities, companies, codes)).select("security_id", "permno", "symbol", "company", "cik", "start_date", "end_date", *LABELS)


def listed_form(usage: DataFrame, listing: DataFrame, master: SecurityMaster | None = None, latest: dt.date | str | None = None) -> DataFrame:
    """usage (symbol, day) with form: the ticker of listing (ticker) that is the same without separators, if that security
    is the one that the symbol meant on the day, as by the master on the day `latest`; otherwise the symbol in upper
    case. Without a day or a master they are taken as the same. An empty symbol stays as it is."""
    key = normal_ticker(F.col("symbol"))
    now = listing.select(normal_ticker(F.col("ticker")).alias("_key"), "ticker").groupBy("_key").agg(F.min("ticker").alias("_ticker"))
    rows = usage.withColumn("_key", key).join(now, "_key", "left")
    same = F.lit(True)
    if master is not None:
        asked = rows.filter("_ticker IS NOT NULL AND day IS NOT NULL").select(F.col("_key").alias("symbol"), F.col("day").cast("date").alias("day")).distinct()
        then = master.security_ids(asked, auto_resolve=False).select(F.col("symbol").alias("_key"), F.col("day").alias("_day"), F.col("security_id").alias("_then"))
        last = asked.select("symbol").distinct().withColumn("day", F.lit(latest).cast("date"))
        last = master.security_ids(last, auto_resolve=False).select(F.col("symbol").alias("_key"), F.col("security_id").alias("_last"))
        rows = rows.withColumn("_day", F.col("day").cast("date")).join(then, ["_key", "_day"], "left").join(last, "_key", "left")
        same = F.col("day").isNull() | F.coalesce(F.col("_then") == F.col("_last"), F.lit(False))
    form = F.when(F.col("symbol") == "", F.col("symbol")).when(F.col("_ticker").isNotNull() & same, F.col("_ticker")).otherwise(F.upper("symbol"))
    return rows.select(*usage.columns, form.alias("form"))


def info(master: SecurityMaster, asked: DataFrame, column: str) -> DataFrame:
    """security_id, day and column of the master's row valid on the day, the earliest of several, null if there is none."""
    wanted = asked.select("security_id", F.col("day").cast("date").alias("day")).distinct()
    rows = master.rows.select(F.col("security_id").alias("_id"), "start_date", "end_date", F.col(column).alias("_value"))
    hit = wanted.join(rows, (F.col("security_id") == F.col("_id")) & SecurityMaster.valid(F.col("day"), open_end=False))
    hit = hit.groupBy("security_id", "day").agg(F.min_by("_value", F.struct("start_date", "end_date", F.col("_value").isNull(), "_value")).alias(column))
    return wanted.join(hit, ["security_id", "day"], "left")


def extend_first(master: DataFrame, listing: DataFrame, today: dt.date | str, latest: dt.date | str, known: DataFrame, figi: DataFrame, labels: DataFrame) -> DataFrame:
    """The master brought to a day's listing (ticker) where no listing came before.

    Rows whose symbol is listed get the listed form, the ticker's figi, and where they have none the exchange, cik and
    company that known (ticker, exchange, cik, company) says; if they end on the day `latest` they end today. Listed tickers
    that no row ending on that day has become new rows, in order of ticker, with the next ids and their labels
    (ticker, sector, industry, subindustry). known, figi (ticker, figi) and labels have a row a ticker without separators."""
    day, end = F.lit(today).cast("date"), F.lit(latest).cast("date")
    now = listing.select(normal_ticker(F.col("ticker")).alias("_key"), "ticker").groupBy("_key").agg(F.min("ticker").alias("_ticker"))
    keyed = lambda df: df.select(normal_ticker(F.col("ticker")).alias("_key"), *(F.col(c).alias(f"_{c}") for c in df.columns if c != "ticker")).dropDuplicates(["_key"])
    facts = now.join(keyed(known), "_key", "left").join(keyed(figi), "_key", "left")
    rows = master.withColumn("_key", normal_ticker(F.col("symbol"))).join(facts, "_key", "left")
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    listed = F.col("_ticker").isNotNull()
    new = {c: F.when(listed & none(c), F.col(f"_{s}")).otherwise(F.col(c)) for c, s in (("exchange", "exchange"), ("cik", "cik"), ("company", "company"), ("share_class_figi", "figi"))}
    new |= {"symbol": F.coalesce("_ticker", "symbol"), "end_date": F.when(listed & (F.col("end_date") == end), day).otherwise(F.col("end_date"))}
    old = rows.select(*(new.get(c, F.col(c)).alias(c) for c in master.columns))
    current = master.filter(F.col("end_date") == end).select(normal_ticker(F.col("symbol")).alias("_key")).distinct()
    # one row for each new listing
    fresh = facts.join(current, "_key", "left_anti").join(keyed(labels), "_key", "left").withColumn("_n", F.row_number().over(Window.orderBy("_key")))
    top = master.agg(F.coalesce(F.max(F.col("security_id").cast("long")), F.lit(1000)).alias("_top"))
    fresh = fresh.crossJoin(F.broadcast(top))
    made: dict[str, Column] = {"security_id": F.col("_top") + F.col("_n"), "symbol": F.col("_ticker"), "company": F.coalesce("_company", F.lit("")), "cik": F.col("_cik"), "share_class_figi": F.col("_figi"), "exchange": F.col("_exchange"), "start_date": day, "end_date": day}
    made |= {c: F.col(f"_{c}") for c in ("sector", "industry", "subindustry")}
    return old.unionByName(fresh.select(*(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in master.dtypes)))
