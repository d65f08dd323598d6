"""Bars as a stream: windowed aggregates with a watermark, and the conditional carry-forward with state per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(trades: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """open, high, low, close, volume of trades (ts, symbol, price, size) by time window; trades later than late are dropped."""
    order = F.col("ts")
    return trades.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume")
    )


def carry_forward(events: DataFrame) -> DataFrame:
    """trade_when over a stream of events (ts, symbol, trade, alpha, leave): symbol, ts, value, null while
    nothing is carried. One value per symbol is kept."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else float("nan")
        rows = pd.concat(list(parts)).sort_values("ts")
        out = []
        for r in rows.itertuples():
            value = float("nan") if r.leave > 0 else r.alpha if r.trade > 0 else value
            out.append(value)
        state.update((value,))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"], "value": out})

    return events.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout)
