import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera import Panel, compute
from tessera.client import Client
from tessera.journal import Journal
from tessera.plans.errors import NoSuchKeyError, SecurityNotFoundError, StorageError, UnknownFieldError
from tessera.plans.fields import FIELDS, build, build_order
from tessera.profiler import measured, profile
from tessera.sources import fundamentals, master_build, tagging, ticks, universe
from tessera.sources.calendar import TradingCalendar
from tessera.sources.objects import ObjectStore
from tessera.sources.security_master import SecurityMaster
from tessera.sources.storage import Storage


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def master(spark):
    rows = [
        (1, "FB", "Face", "0001", day("2012-05-18"), day("2022-06-08")), (1, "META", "Face", "0001", day("2022-06-09"), day("2024-12-31")),
        (2, "ABC", "First", "0002", day("2010-01-01"), day("2015-01-01")), (3, "ABC", "Second", "0003", day("2018-01-01"), day("2024-12-31")),
        (2, "XYZ", "First", "0002", day("2015-01-02"), day("2024-12-31")),
    ]
    return SecurityMaster(spark.createDataFrame(rows, "security_id long, symbol string, company string, cik string, start_date date, end_date date"))


def test_resolution(master):
    assert master.resolve("FB").security_id == 1  # a single row needs no date
    assert master.resolve("FB", "2023-01-01") is None
    assert master.resolve("ABC", "2012-01-01").security_id == 2 and master.resolve("ABC", "2020-01-01").security_id == 3
    assert master.resolve("0003", "2020-01-01").symbol == "ABC" and master.resolve("none") is None
    assert master.security_id("META", "2015-01-01") == 1  # not its name then
    assert master.security_id("ABC", "2016-06-01") == 2  # the only one active then
    with pytest.raises(SecurityNotFoundError):
        master.security_id("META", "2015-01-01", auto_resolve=False)
    assert {(r.symbol, r.security_id) for r in master.in_years(2012, 2020).collect()} == {("FB", 1), ("XYZ", 2), ("ABC", 3)}
    assert [r.symbol for r in master.search("se", "2020-01-01").collect()] == ["ABC"]
    assert {r.symbol for r in master.history(1).collect()} == {"FB", "META"}


def test_master_update(spark, master):
    u = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    figi = spark.createDataFrame([("META", "F1"), ("MTX", "F1"), ("NEW", None)], "ticker string, figi string")
    out = master.update(u("META", "ABC", "XYZ"), u("MTX", "A.BC", "NEW"), figi, "2025-01-10", 30, "2024-12-31").collect()
    rows = {(r.symbol, r.security_id): r for r in out}
    assert rows["MTX", 1].start_date == day("2025-01-10") and rows["META", 1].end_date == day("2024-12-31")
    assert rows["A.BC", 3].end_date == day("2025-01-10") and rows["XYZ", 2].end_date == day("2024-12-31")
    assert ("NEW", 4) in rows and len(out) == 7


def test_common_stock(spark):
    names = {"Apple Inc. Common Stock": True, "X Series A Preferred": False, "Uniti Group": True, "Acme Units": False, "Big Income Trust": False, "Realty Income Trust": True, "Y Warrant": False, "5% Z": False, "": False, None: False, "W ADR": False}
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("ok", universe.is_common_stock(F.col("n")))
    assert {r.n: r.ok for r in df.collect()} == names


def test_top(spark):
    df = spark.createDataFrame([("A", 10.0, 1000), ("B", 20.0, 1000), ("C", 1.0, 10), ("B", 40.0, 1000)], "symbol string, close double, volume long")
    assert [r.symbol for r in universe.top_by_dollar_volume(df, 2).collect()] == ["B", "A"]


def test_ticks(spark, tmp_path):
    store = Storage(spark, str(tmp_path))
    t = ticks.Ticks(store)
    mk = lambda rows: spark.createDataFrame(rows, "security_id long, timestamp string, close double, volume double")
    assert not t.has_year(1, 2023)
    t.publish(mk([(1, "2023-01-02", 1.00004, 5.0), (1, "2024-01-02", 2.0, 6.0), (2, "2024-01-02", 3.0, 7.0)]), 2023, 2024)
    t.publish(mk([(1, "2024-01-03", 4.0, 8.0)]), 2024, 2024)
    got = sorted((r.security_id, r.timestamp, r.close) for r in t.history().collect())
    assert got == [(1, "2023-01-02", 1.0), (1, "2024-01-03", 4.0), (2, "2024-01-02", 3.0)]
    assert t.has_year(2, 2024) and not t.has_year(2, 2023)
    assert [r.security_id for r in t.missing(spark.createDataFrame([(1,), (2,)], "security_id long"), 2023).collect()] == [2]
    assert t.history([1], "2024-01-01", "2024-12-31").count() == 1
    bar = spark.createDataFrame([('{"t":"2024-07-01T04:00:00Z","o":1,"h":2,"l":0.5,"c":1.5,"v":10,"n":3,"vw":1.2}',)], "value string")
    r = ticks.parse_bars(bar).first()
    assert r.timestamp == "2024-07-01T00:00:00" and r.volume == 10 and r.vwap == 1.2


def test_calendar(spark):
    c = TradingCalendar(spark.createDataFrame([(day("2024-01-31"),), (day("2024-02-01"),), (day("2024-02-29"),)], "timestamp date"))
    assert c.of_year(2024, 2).count() == 2 and c.is_trading_day("2024-02-29") and not c.is_trading_day("2024-02-28") and c.last_days("2024-02-10", 1).first()[0] == day("2024-02-01")


def test_quarters(spark):
    rows = [("S", "c", "a1", "CY2020Q1", "2020-01-01", "2020-03-31", "2020-05-01", 1.0), ("S", "c", "a2", "CY2020Q1", "2020-01-01", "2020-03-31", "2020-06-01", 2.0), ("S", "c", "a3", "CY2020Q2", "2020-04-01", "2020-06-30", "2020-08-01", 3.0), ("S", "c", "a4", "CY2020Q3", "2020-07-01", "2020-09-30", "2020-11-01", 4.0), ("S", "c", "a5", "CY2020", "2020-01-01", "2020-12-31", "2021-02-01", 20.0), ("S", "c", "a6", "CY2021", "2021-01-01", "2021-12-31", "2022-02-01", 9.0), ("S", "c", "a7", None, "2021-01-01", "2021-12-31", "2022-02-01", 9.0)]
    df = spark.createDataFrame(rows, "symbol string, concept string, accn string, frame string, start string, end string, filed string, val double")
    got = {r.frame: (r.val, r.start) for r in fundamentals.quarterly(df).collect()}
    assert got == {"CY2020Q1": (2.0, day("2020-01-01")), "CY2020Q2": (3.0, day("2020-04-01")), "CY2020Q3": (4.0, day("2020-07-01")), "CY2020": (11.0, day("2020-10-01"))}


def test_fields(spark):
    assert len(FIELDS) == 66 and build_order({"cap"}).index("sharesout") < build_order({"cap"}).index("cap")
    with pytest.raises(UnknownFieldError):
        build_order({"nothing"})
    days = [day("2024-01-01") + dt.timedelta(days=i) for i in range(5)]
    cal = spark.createDataFrame([(d,) for d in days], "date date")
    t = spark.createDataFrame([("A", days[0], 10.0, 1.0), ("A", days[2], 12.0, 2.0), ("B", days[1], 5.0, 3.0)], "symbol string, date date, close double, volume double")
    f = spark.createDataFrame([("A", days[1], "sharesout", 100.0), ("A", day("2023-12-25"), "income", 7.0), ("A", days[3], "income", 50.0)], "symbol string, date date, concept string, value double")
    m = spark.createDataFrame([("A", "Tech", days[0]), ("A", "New", days[1])], "symbol string, sector string, start_date date")
    rows = build(cal, t, f, m, {"close", "returns", "cap", "eps", "sector", "vwap", "split"}).df.orderBy("symbol", "date_idx").collect()
    a = [r for r in rows if r.symbol == "A"]
    assert len(rows) == 10 and [r.cap for r in a] == [None, None, 1200.0, None, None] and [r.eps for r in a] == [None, None, None, 0.5, 0.5]
    assert {r.sector for r in rows} == {"New", None} and {r.split for r in rows} == {1.0} and a[0].vwap is None and a[1].returns is None
    assert len(build(cal, t).df.columns) == 69


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path))
    pnl = [(f"2024-01-{i + 1:02d}", r) for i, r in enumerate([0.1, -0.2, 0.3, 0.05])]
    v1, ok1, _ = j.submit("one", "rank(close)", pnl, 1.0, tags=["a, b", "c"])
    assert j.table("alphas").first()["tags"] == ["a, b", "c"]
    v2, ok2, block = j.submit("two", "rank(open)", pnl, 1.05)
    v3, ok3, _ = j.submit("three", "x", pnl, 1.2)
    assert ok1 and not ok2 and block[0]["version_id"] == v1 and math.isclose(block[0]["improvement"], 5.0, rel_tol=1e-9) and ok3
    j.force_submit(v2)
    assert j.submitted().count() == 3 and j.correlations(v2).count() == 1
    j.delete(j.table("versions").filter(F.col("version_id") == v1).first()["alpha_id"])
    assert j.submitted().count() == 2 and j.correlations(v2).count() == 0
    # two writers: an acceptance and a removal that know nothing of each other
    one, two = Journal(spark, str(tmp_path)), Journal(spark, str(tmp_path))
    v4, ok4, _ = one.submit("four", "y", pnl, 1.1)
    two.delete(two.table("versions").filter(F.col("version_id") == v3).first()["alpha_id"])
    one.force_submit(v4)
    assert not ok4 and {r["version_id"] for r in j.submitted().collect()} == {v2, v4} and one.submit("one", "z", pnl, 9.0)[1]


def test_objects(tmp_path):
    s = ObjectStore(str(tmp_path))
    s.put("a/b/one", b"1", {"k": "v"})
    s.put("a/two", b"22")
    assert s.get("a/b/one") == (b"1", {"k": "v"}) and s.head("a/two")["size"] == 2
    assert s.list("a/", "/") == {"keys": ["a/two"], "prefixes": ["a/b/"], "next": None} and s.list(limit=1)["next"] == "a/b/one"
    s.delete("a/two")
    for bad, error in (("a/two", NoSuchKeyError), ("../x", StorageError)):
        with pytest.raises(error):
            s.get(bad)


def test_storage_and_client(spark, tmp_path):
    import pyarrow as pa

    s = Storage(spark, str(tmp_path))
    days = [day("2024-01-01") + dt.timedelta(days=i) for i in range(6)]
    s.write_parquet(spark.createDataFrame([(d,) for d in days], "date date"), "calendar")
    s.write_parquet(spark.createDataFrame([(11, "AA", "A Co", "1", days[0], None), (22, "BB", "B Co", "2", days[0], None)], "security_id long, symbol string, company string, cik string, start_date date, end_date date"), "master")
    s.write_parquet(spark.createDataFrame([("AA",), ("BB",)], "symbol string"), "universe")
    t = spark.createDataFrame([(k, d, float(i + n)) for n, k in enumerate(("11", "22")) for i, d in enumerate(days)], "symbol string, date date, close double")
    c = Client(spark, str(tmp_path))
    assert c.build_fields(t, names={"close", "returns"}) and not c.build_fields(t, names={"close", "returns"})
    assert c.universe() == ["AA", "BB"] and c.lookup("2", "2024-01-03").symbol == "BB"
    assert [r["AA"] for r in c.get("close", ["AA"], "2024-01-02", "2024-01-04").collect()] == [1.0, 2.0, 3.0]
    q = c.query("rank(-ts_delta(close, 1))", start="2024-01-01", end="2024-01-06")
    assert q.count() == 12 and {r.symbol for r in q.collect()} == {"AA", "BB"}
    with pytest.raises(UnknownFieldError):
        c.get("nothing")
    table = pa.table({"d": [1, 2], "v": [0.5, None]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert [tuple(r) for r in s.scan_ipc("x.arrow").collect()] == [(1, 0.5), (2, None)] and s.read_ipc("x.arrow", ["v"]).columns == ["v"]
    assert s.read_parquet("calendar", filters=[F.col("date") > days[3]]).count() == 2
    with pytest.raises(StorageError):
        s.scan_parquet("nowhere")


def test_profile(spark):
    df = spark.createDataFrame([(day("2024-01-01"), "A", 1.0)], "date date, symbol string, x double")
    out = compute("rank(ts_mean(x, 3))", Panel.densify(df))
    p = profile("rank(ts_mean(x, 3))", out)
    assert p.operators == {"rank": 1, "ts_mean": 1} and p.windows == 3 and p.levels == 2 and p.nodes["Window"] >= 2


def test_measured(spark):
    df = spark.createDataFrame([(day("2024-01-01"), s, float(i)) for i, s in enumerate("ABCDE")], "date date, symbol string, x double")
    steps = measured(compute("rank(ts_mean(x, 3))", Panel.densify(df)))
    assert {"Window", "Exchange"} <= {s.node for s in steps}
    assert max(s.rows for s in steps if s.node == "Exchange" and s.rows is not None) == 5
    assert any(s.milliseconds is not None for s in steps)


def test_streaming(spark, tmp_path):
    from tessera.streaming.stateful import bars, carry_forward

    src = str(tmp_path / "in")
    spark.createDataFrame([("A", 1, 1.0, 10.0, 0.0), ("A", 2, 0.0, 20.0, 0.0), ("A", 3, 0.0, 30.0, 1.0), ("B", 1, 1.0, 5.0, 0.0)], "symbol string, n int, trade double, alpha double, leave double").selectExpr("timestamp_seconds(n) AS ts", "symbol", "trade", "alpha", "leave").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, symbol string, trade double, alpha double, leave double").parquet(src)
    q = carry_forward(stream).writeStream.format("memory").queryName("carried").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.symbol, r.ts.second): r.value for r in spark.sql("SELECT * FROM carried").collect()}
    assert got["A", 1] == 10 and got["A", 2] == 10 and got["A", 3] is None and got["B", 1] == 5
    trades = spark.readStream.schema("ts timestamp, symbol string, trade double, alpha double, leave double").parquet(src).selectExpr("ts", "symbol", "alpha AS price", "trade AS size")
    q = bars(trades, "1 hour").writeStream.format("memory").queryName("bars").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.symbol, r.open, r.close) for r in spark.sql("SELECT * FROM bars").collect()} == {("A", 10.0, 30.0), ("B", 5.0, 5.0)}


def test_tagging(spark, tmp_path):
    c = spark.createDataFrame([(f"s{i}", float(i), "xy"[i % 2]) for i in range(30)], "symbol string, size double, industry string")
    got = tagging.stratified_sample(c, 12).collect()
    assert len(got) == 12 and {(r.tier, r.industry) for r in got} == {(t, k) for t in range(3) for k in "xy"} and got == tagging.stratified_sample(c.repartition(5), 12).collect()
    concepts = spark.createDataFrame([("sales", "Sales revenue net")], "concept string, description string")
    usage = spark.createDataFrame([("SalesRevenueNet", 9, "Sales Revenue, Net"), ("SalesTable", 99, "Sales Revenue, Net"), ("Goodwill", 5, "Goodwill")], "tag string, filings long, label string")
    assert [(r.concept, r.tag) for r in tagging.suggest(concepts, usage).collect()] == [("sales", "SalesRevenueNet")]
    m = spark.createDataFrame([("Tech",), ("None",)], "s string").select(tagging.mapped(F.col("s"), {"Tech": "Information Technology"}).alias("g"))
    assert [r.g for r in m.collect()] == ["Information Technology", None]
    f = spark.createDataFrame([("a", day("2024-01-01")), ("b", day("2024-02-01")), ("a", None)], "concept string, as_of_date date")
    assert tagging.publish(f, str(tmp_path / "f")) == {"rows": 3, "concepts": 2, "latest": day("2024-02-01")}


def write_tables(spark, path, lineitem, suppliers):
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lineitem, schema).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(s, s % 25) for s in suppliers], "s_suppkey long, s_nationkey int").write.parquet(f"{path}/supplier.parquet")


def test_the_registered_matrix_has_all_symbols(spark, tmp_path):
    from tessera.plans import catalog_data

    rows = [(k, 1, k % 7 + 1, dt.datetime(2020, 1, 6) + dt.timedelta(days=k * 5 % 40), float(k), 10.0 * k) for k in range(60)]
    write_tables(spark, str(tmp_path), rows, range(1, 8))
    want = {}
    for _, _, s, when, n, _ in rows:
        key = (when.date() - dt.timedelta(days=when.weekday()), f"{s:08d}")
        want[key] = want.get(key, 0.0) + n
    got = catalog_data.QUERIES["panel_wide_all"](spark, str(tmp_path))
    symbols = [f"{s:08d}" for s in range(1, 8)]
    assert got.columns == ["date", *symbols]
    assert {(r.date, s): r[s] for r in got.collect() for s in symbols if r[s] is not None} == want
    assert [r.date for r in got.collect()] == sorted({d for d, _ in want})


def test_a_matrix_is_widened_without_a_pivot(spark, monkeypatch):
    """Batches, tasks and dates need not coincide; dates and symbols without facts stay; the plan has no expression for each symbol."""
    from tessera.plans import panel as module

    monkeypatch.setattr(module, "PART_CELLS", 15, raising=False)
    monkeypatch.setattr(module, "BATCH_CELLS", 10, raising=False)
    days, names = [dt.date(2024, 1, d) for d in range(1, 12)], [f"s{k}" for k in range(5)]
    facts = [(d, s, float(i * 10 + j) if i % 3 else None, f"{s}.{i}") for i, d in enumerate(days) for j, s in enumerate(names) if (i + j) % 4 and i != 6 and j != 3]
    df = spark.createDataFrame(facts, "date date, symbol string, x double, name string")
    p = Panel.densify(df, spark.createDataFrame([(d,) for d in days], "date date"), spark.createDataFrame([(s,) for s in names], "symbol string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for place, field in ((2, "x"), (3, "name")):
            want = {(f[0], f[1]): f[place] for f in facts}
            wide = p.to_wide(field)
            assert wide.columns == ["date", *names] and wide.dtypes[1][1] == dict(df.dtypes)[field]
            assert [tuple(r) for r in wide.collect()] == [(d, *(want.get((d, s)) for s in names)) for d in days]
            assert "pivot" not in wide._jdf.queryExecution().analyzed().toString().lower()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Panel.densify(df.limit(0)).to_wide("x").collect() == []


def test_arithmetic_rounds_as_its_sql(spark, tmp_path):
    """Cells that lie on a half of the fourth digit once shifted: 2 * (close + 1) - high / 1000 ** 2 ends in 33."""
    import duckdb

    from tessera.plans import catalog

    cells = [(1967, 967, 1687), (39367, 38367, 39367), (54067, 53067, 53067), (25367, 24367, 25367), (63248, 43787, 43787), (64972, 58317, 58317), (5000, 5000, 5000), (5000, 4999, 4999)]
    rows = [(3 * k + j, 1, k + 1, dt.datetime(2020, 1, 6), 1.0, float(price)) for k, (high, low, close) in enumerate(cells) for j, price in enumerate((high, low, close))]
    write_tables(spark, str(tmp_path), rows, range(1, len(cells) + 1))
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[1]: r[2] for r in con.execute(catalog.ORACLE_SQL["lang_arithmetic"]).fetchall()}
    got = {r.symbol: r.value for r in catalog.QUERIES["lang_arithmetic"](spark, str(tmp_path)).collect()}
    assert got == want and got["00000001"] == 3375.9981


def test_rounding_of_large_and_missing_values(spark):
    from tessera.plans.catalog import settle

    values = [1e308, -1e308, math.inf, -math.inf, math.nan, None, -0.0, 1e17, -2.00005]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(settle(F.col("v"), "double", 4).alias("x")).collect()]
    assert got == [1e308, -1e308, math.inf, -math.inf, None, None, 0.0, 1e17, -2.0]


def test_ticks_of_all_months_are_parsed(spark, tmp_path):
    from zoneinfo import ZoneInfo

    from tessera.plans import catalog_data

    start = dt.datetime(2024, 1, 1, 3, 30, tzinfo=dt.timezone.utc)
    times = [start + dt.timedelta(hours=41 * k) for k in range(214)]
    times += [dt.datetime(2024, m, d, h, 59, 59, tzinfo=dt.timezone.utc) for m, d in ((3, 10), (11, 3)) for h in (5, 6, 7)]
    rows = [(k, k % 5, t.strftime("%Y-%m-%d %H:%M:%S"), k / 8) for k, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.timestamp for r in catalog_data.QUERIES["ticks_parse_all"](spark, str(tmp_path)).collect()}
    assert got == {k: t.astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%dT%H:%M:%S") for k, t in enumerate(times)}


def test_likeness_is_the_token_set_ratio(spark):
    pairs = {("net income", "Net income loss attributable to parent"): 100.0, ("revenue", "Revenues"): 100 - 100 / 15, ("net income", None): 0.0, ("", "x"): 0.0, ("cost of goods", "Cost of sales"): 70.0}
    df = spark.createDataFrame(list(pairs), "a string, b string").withColumn("x", tagging.likeness(F.col("a"), F.col("b")))
    assert {(r.a, r.b): round(r.x, 9) for r in df.collect()} == {k: round(v, 9) for k, v in pairs.items()}
    concepts = spark.createDataFrame([("net_income", "net income")], "concept string, description string")
    usage = spark.createDataFrame([("ProfitLoss", 5, "Net income loss attributable to parent")], "tag string, filings long, label string")
    assert [r.tag for r in tagging.suggest(concepts, usage).collect()] == ["ProfitLoss"]


def test_the_most_reliable_cik_of_a_name(spark):
    names = [(1, "A", "x", "123456AAZ", day("2020-01-01"), day("2020-12-31")), (1, "A", "x", "123456AAZ", day("2021-01-01"), day("2021-12-31")), (2, None, "y", "123456AA", day("2020-01-01"), day("2020-02-01")), (3, "B", None, None, day("2020-01-01"), day("2020-02-01"))]
    links = [("123456AAQQ", "1", day("2019-01-01"), day("2020-06-30")), ("123456AA", "2", day("2020-01-01"), day("2025-01-01")), ("123456AA", None, None, None), ("123456BB", "3", day("2000-01-01"), day("2030-01-01")), ("123456AA", "0", day("2022-06-01"), day("2040-01-01"))]
    n = spark.createDataFrame(names, "permno int, symbol string, company string, cusip string, start_date date, end_date date")
    k = spark.createDataFrame(links, "cusip string, cik string, cik_from date, cik_to date")
    got = sorted(map(tuple, master_build.periods(n, k).collect()))
    assert got == [(1, "A", "x", "2", "123456AAZ", day("2020-01-01"), day("2021-12-31")), (3, "B", None, None, None, day("2020-01-01"), day("2020-02-01"))]
    listed = master_build.listed_ciks(spark.createDataFrame([("b", 9), ("B", 7), ("", 1), ("C", 0)], "ticker string, cik_str long"))
    assert {r.symbol: r.cik for r in master_build.fill_ciks(master_build.periods(n, k), listed).collect()} == {"A": "2", "B": "0000000007"}
    assert master_build.periods(n.limit(0), k).count() == 0 and master_build.periods(n, k.limit(0)).filter("cik IS NOT NULL").count() == 0


def test_first_extension_of_a_master(spark):
    schema = "security_id long, symbol string, company string, cik string, share_class_figi string, start_date date, end_date date, exchange string, sector string, industry string, subindustry string"
    rows = [(1001, "BRKB", "", None, None, day("2000-01-01"), day("2024-12-31"), None, "f", None, None), (1002, "OLD", "o", "1", "g", day("2000-01-01"), day("2024-12-31"), None, None, None, None), (1003, "NEW", "n", "5", None, day("2000-01-01"), day("2010-01-01"), "q", None, None, None)]
    listing = spark.createDataFrame([("BRK.B",), ("new",), ("ZZ",)], "ticker string")
    known = spark.createDataFrame([("BRK-B", "N", "77", "Berk"), ("ZZ", "O", "88", "Zed")], "ticker string, exchange string, cik string, company string")
    figi = spark.createDataFrame([("BRK.B", "F1"), ("NEW", "F2")], "ticker string, figi string")
    labels = spark.createDataFrame([("ZZ", "tech", "semi", None)], "ticker string, sector string, industry string, subindustry string")
    got = {(r.security_id, r.symbol): r for r in master_build.extend_first(spark.createDataFrame(rows, schema), listing, "2025-03-03", "2024-12-31", known, figi, labels).collect()}
    assert set(got) == {(1001, "BRK.B"), (1002, "OLD"), (1003, "new"), (1004, "new"), (1005, "ZZ")}
    b, z, old = got[1001, "BRK.B"], got[1005, "ZZ"], got[1003, "new"]
    assert (b.end_date, b.cik, b.company, b.exchange, b.share_class_figi, b.sector) == (day("2025-03-03"), "77", "Berk", "N", "F1", "f")
    assert got[1002, "OLD"].end_date == day("2024-12-31") and (old.end_date, old.cik, old.exchange, old.share_class_figi) == (day("2010-01-01"), "5", "q", "F2")
    assert (z.start_date, z.end_date, z.sector, z.industry, z.cik, z.share_class_figi) == (day("2025-03-03"), day("2025-03-03"), "tech", "semi", "88", None) and got[1004, "new"].company == ""


def test_labels_by_industry_then_sector(spark):
    mapping = [("industry", "Chips", "IT", "Semis", "Semiconductors"), ("sector", "Technology", "IT", None, None), ("sector", "Energy", "EN", None, None)]
    m = spark.createDataFrame(mapping, "level string, name string, sector string, industry string, subindustry string")
    rows = spark.createDataFrame([(1, "Energy", "Chips"), (2, "Energy", "Wells"), (3, None, None), (4, "No", "No")], "id int, sector_name string, industry_name string")
    got = {r.id: (r.sector, r.industry, r.subindustry) for r in master_build.to_gics(rows, m).collect()}
    assert got == {1: ("IT", "Semis", "Semiconductors"), 2: ("EN", None, None), 3: (None, None, None), 4: (None, None, None)}


def test_symbols_as_listed(spark):
    m = SecurityMaster(spark.createDataFrame([(1, "BRKB", day("2000-01-01"), day("2024-12-31")), (2, "AB", day("2000-01-01"), day("2010-01-01")), (3, "AB", day("2011-01-01"), day("2024-12-31"))], "security_id long, symbol string, start_date date, end_date date"))
    listing = spark.createDataFrame([("BRK.B",), ("A-B",)], "ticker string")
    asked = [("brk-b", "2015-01-01"), ("ab", "2005-01-01"), ("ab", "2015-01-01"), ("ab", None), ("gone", "2015-01-01"), ("", None), ("brkb", "1990-01-01")]
    got = {(r.symbol, r.day): r.form for r in master_build.listed_form(spark.createDataFrame(asked, "symbol string, day string"), listing, m, "2024-12-31").collect()}
    assert got == {asked[0]: "BRK.B", asked[1]: "AB", asked[2]: "A-B", asked[3]: "A-B", asked[4]: "GONE", asked[5]: "", asked[6]: "BRKB"}
    assert {r.form for r in master_build.listed_form(spark.createDataFrame(asked[:2], "symbol string, day string"), listing).collect()} == {"BRK.B", "A-B"}


def test_text_and_csv_tables(spark, tmp_path):
    from pathlib import Path

    store = Storage(spark, str(tmp_path))
    store.write_text(spark.createDataFrame([("B",), ("A",)], "symbol string"), "top")
    assert sorted(line for p in Path(tmp_path).rglob("part-*") for line in p.read_text().split()) == ["A", "B"]
