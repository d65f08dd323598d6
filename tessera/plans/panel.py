"""The panel: one dense tall table, a row for every date of the calendar and every symbol.

Rolling operators count rows of the calendar, so density is established before any window: calendar x symbols, left
join facts. The calendar and the symbols are one row per date and per symbol; their product is the panel's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.plans.errors import ColumnMismatchError, DateMismatchError, PanelError

DATE, INDEX, SYMBOL = "date", "date_idx", "symbol"
#: Rows of a calendar that may be broadcast; longer ones are joined by shuffling.
CALENDAR_LIMIT = 1_000_000
#: Cells of a matrix that one task widens, and that it holds at once.
PART_CELLS, BATCH_CELLS = 1 << 25, 1 << 19


class Panel:
    """df: date, date_idx (0, 1, ... over the calendar), symbol, and a column for each field."""

    def __init__(self, df: DataFrame):
        missing = {DATE, INDEX, SYMBOL} - set(df.columns)
        if missing:
            raise PanelError(f"a panel needs the columns {sorted(missing)}")
        self.df = df

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in (DATE, INDEX, SYMBOL)]

    @classmethod
    def densify(cls, facts: DataFrame, calendar: DataFrame | None = None, symbols: DataFrame | None = None) -> Panel:
        """facts: date, symbol and fields, at most one row for each pair. calendar (date) and symbols (symbol) default to
        those of facts. Facts off the calendar are left out."""
        dates = calendar.select(DATE).distinct() if calendar is not None else facts.select(DATE).distinct().filter(F.col(DATE).isNotNull())
        # one row per date, numbered in a single task: a calendar is small whatever the data
        dates = dates.withColumn(INDEX, (F.row_number().over(Window.orderBy(DATE)) - 1).cast("int"))
        names = symbols.select(SYMBOL).distinct() if symbols is not None else facts.select(SYMBOL).distinct().filter(F.col(SYMBOL).isNotNull())
        # every symbol gets its own copy of the calendar; the calendar side is bounded and broadcast, symbols stay spread
        grid = names.join(F.broadcast(dates)) if _small(dates) else names.crossJoin(dates)
        return cls(grid.join(facts, [DATE, SYMBOL], "left").select(DATE, INDEX, SYMBOL, *(c for c in facts.columns if c not in (DATE, SYMBOL))))

    @classmethod
    def from_wide(cls, **wide: DataFrame) -> Panel:
        """Fields from matrices: first column the date, one column for each symbol. All need the same symbols and dates."""
        if not wide:
            raise PanelError("no fields")
        columns = {k: tuple(df.columns[1:]) for k, df in wide.items()}
        first = next(iter(columns.values()))
        for k, c in columns.items():
            if set(c) != set(first):
                raise ColumnMismatchError(f"{k} has other symbols: {sorted(set(c) ^ set(first))[:10]}")
        tall: DataFrame | None = None
        dates: set | None = None
        for k, df in wide.items():
            d = df.columns[0]
            part = df.select(F.col(d).cast("date").alias(DATE), *df.columns[1:]).unpivot([DATE], list(first), SYMBOL, k) if not dict(df.dtypes)[first[0]].startswith("array") else _unpivot_arrays(df, d, first, k)
            have = {r[0] for r in df.select(F.col(d).cast("date")).collect()}
            if dates is not None and have != dates:
                raise DateMismatchError(f"{k} has {len(have)} dates, others {len(dates)}")
            dates = have
            tall = part if tall is None else tall.join(part, [DATE, SYMBOL])
        order = F.array_position(F.array(*(F.lit(s) for s in first)), F.col(SYMBOL))
        panel = cls.densify(tall)
        panel.df = panel.df.withColumn("symbol_pos", order.cast("int"))
        return panel

    def to_wide(self, value: str) -> DataFrame:
        """The matrix of one field: date and a column for each symbol, in order of dates. Rows travel tall, each to the part that
        holds its date, and are widened there: a pivot's plan has several expressions for each symbol, on the driver."""
        names = sorted(r[0] for r in self.df.select(SYMBOL).distinct().collect())
        tall = self.df.select(DATE, SYMBOL, F.col(value).alias("value"))
        kind = {f.name: f.dataType for f in tall.schema}
        schema = StructType([StructField(DATE, kind[DATE]), *(StructField(str(s), kind["value"]) for s in names)])
        parts = -(-tall.select(DATE).distinct().count() * len(names) // PART_CELLS) or 1
        return tall.repartitionByRange(parts, DATE).sortWithinPartitions(DATE).mapInArrow(_widened(names), schema)

    def with_fields(self, **columns: Column) -> Panel:
        return Panel(self.df.withColumns(columns))

    def between(self, start=None, end=None) -> Panel:
        df = self.df
        if start is not None:
            df = df.filter(F.col(DATE) >= F.lit(start).cast("date"))
        if end is not None:
            df = df.filter(F.col(DATE) <= F.lit(end).cast("date"))
        return Panel(df)

    def by_symbol(self, partitions: int | None = None) -> Panel:
        """The same rows dealt by symbol and in date order: kept so, in memory or in a bucketed table, windows over the rows
        of a symbol need neither exchange nor sort, however many formulas read the panel."""
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return Panel(self.df.repartition(n, SYMBOL).sortWithinPartitions(SYMBOL, INDEX))

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession


def _unpivot_arrays(df: DataFrame, date: str, symbols: tuple[str, ...], name: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(s).alias(SYMBOL), F.col(f"`{s}`").cast("array<double>").alias(name)) for s in symbols))
    return df.select(F.col(date).cast("date").alias(DATE), F.inline(pairs))


def _widened(names: list) -> Callable[[Iterator], Iterator]:
    """Rows of date, symbol and value, in order of dates, to a row for each date. The first row of a date and symbol holds."""
    most = max(1, BATCH_CELLS // max(1, len(names)))

    def widen(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        columns = [DATE, *map(str, names)]

        def matrix(days):
            values = pa.concat_arrays([v for _, parts in days for _, v in parts])
            source = np.full((len(names), len(days)), -1)
            at = 0
            for j, (_, parts) in enumerate(days):
                places = np.concatenate([p for p, _ in parts])
                source[places[::-1], j] = np.arange(at, at + len(places))[::-1]
                at += len(places)
            source = source.ravel()
            cells = values.take(pa.array(source, mask=source < 0))
            return pa.RecordBatch.from_arrays([pa.concat_arrays([d for d, _ in days]), *(cells.slice(k * len(days), len(days)) for k in range(len(names)))], columns)

        known = None
        days: list = []  # a date, and the places and values of its rows, batch by batch
        for batch in batches:
            if not batch.num_rows:
                continue
            dates, symbols, values = batch.columns
            known = pa.array(names, symbols.type) if known is None else known
            places = pc.index_in(symbols, known).to_numpy(zero_copy_only=False)
            codes = dates.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in pairwise(starts):
                part = (places[a:b], values.slice(a, b - a))
                if days and days[-1][0][0].as_py() == dates[a].as_py():
                    days[-1][1].append(part)
                    continue
                if len(days) == most:
                    yield matrix(days)
                    days = []
                days.append((dates.slice(a, 1), [part]))
        if days:
            yield matrix(days)

    return widen


def _small(dates: DataFrame) -> bool:
    return dates.limit(CALENDAR_LIMIT + 1).count() <= CALENDAR_LIMIT
