"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8). A query's seconds are the
median of three runs after a warm-up, from building the plan to the last row, written to a sink that discards rows.

BENCH_PANEL, say 2262x5704: only the formulas, once each, over a made panel of so many dates and symbols instead."""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: name: formula over the weekly panel, which is built once and kept, as a store of fields would be.
FORMULAS = {
    "add": "add(close, volume)", "divide": "divide(close, volume)", "log": "ops.log(close)", "power": "power(unit, 2)", "gt": "gt(close, open)", "and_": "and_(gt(close, open), gt(volume, 30))", "if_else": "if_else(gt(close, open), high, low)", "densify": "densify(close)",
    "ts_mean": "ts_mean(close, 20)", "ts_std": "ts_std(close, 20)", "ts_delta": "ts_delta(close, 5)", "ts_product": "ts_product(unit, 20)", "ts_zscore": "ts_zscore(close, 20)", "ts_arg_max": "ts_arg_max(close, 20)", "ts_backfill": "ts_backfill(close, 20)", "last_diff_value": "last_diff_value(close, 20)",
    "days_from_last_change": "days_from_last_change(close)", "hump": "hump(close)", "ts_decay_linear": "ts_decay_linear(close, 20)", "ts_rank": "ts_rank(close, 20)", "ts_corr": "ts_corr(close, volume, 20)", "ts_covariance": "ts_covariance(close, volume, 20)", "ts_quantile": "ts_quantile(close, 20)", "ts_regression": "ts_regression(close, volume, 20)",
    "rank": "rank(close)", "zscore": "zscore(close)", "scale": "scale(close)", "normalize": "normalize(close)", "quantile": "quantile(close)", "winsorize": "winsorize(close)", "bucket": "bucket(close, '0,60000,5000')",
    "group_rank": "group_rank(close, g)", "group_zscore": "group_zscore(close, g)", "group_mean": "group_mean(close, volume, g)", "group_backfill": "group_backfill(close, g, 20)", "trade_when": "trade_when(gt(volume, 40), close, lt(volume, 10))",
    "momentum": "rank(-ts_delta(close, 5))", "nested": "zscore(ts_mean(ts_delta(close, 1), 4)) * rank(volume)",
}


def made_panel(spark, dates, symbols):
    """Seeded noise, one value in twenty missing; g has ten groups."""
    from pyspark.sql import functions as F

    from tessera.plans.panel import Panel

    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
    fields = {"open": noise(1) * 60000, "high": noise(2) * 60000, "low": noise(3) * 60000, "close": F.when(noise(4) > 0.05, noise(5) * 60000), "volume": noise(6) * 50, "unit": noise(7) + 0.5}
    rows = spark.range(dates * symbols).select(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % dates).cast("int")).alias("date"), (F.col("id") % dates).cast("int").alias("date_idx"), F.format_string("S%05d", F.floor(F.col("id") / dates)).alias("symbol"), F.concat(F.lit("g"), F.floor(F.col("id") / dates) % 10).alias("g"), *(c.alias(n) for n, c in fields.items()))
    return Panel(rows)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.catalog import weekly_panel
    from tessera.plans.run import compute

    # kept as a store of fields keeps it: by symbol, in date order
    size = os.environ.get("BENCH_PANEL")
    panel = (made_panel(spark, *map(int, size.split("x"))) if size else weekly_panel(spark, SF_DIR)).by_symbol(int(CPUS) * (4 if size else 1))
    panel.df.cache().count()
    took = {}

    def timed(name, make, runs=3):
        def once():
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t

        once()
        took[name] = round(median(once() for _ in range(runs)), 4)

    for name, f in FORMULAS.items():
        timed(name, lambda f=f: compute(f, panel), runs=1 if size else 3)
    if size:
        print(json.dumps({"metric": f"total seconds of the formulas over {size}", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took}))
        spark.stop()
        return
    timed("panel_build", lambda: weekly_panel(spark, SF_DIR).df)
    try:
        from tessera.llm.queries import QUERIES
    except ModuleNotFoundError:
        QUERIES = {}
    for name, q in QUERIES.items():
        timed(name, lambda q=q: q(spark, SF_DIR), runs=1)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
