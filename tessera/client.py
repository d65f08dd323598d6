"""One entry to a store of fields, a master and universes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.plans.errors import ConfigurationError, UnknownFieldError
from tessera.plans.fields import FIELDS, build
from tessera.plans.language import field_refs
from tessera.plans.panel import Panel
from tessera.plans.run import compute
from tessera.sources.calendar import TradingCalendar
from tessera.sources.security_master import SecurityMaster
from tessera.sources.storage import Storage

FIRST_DAY = "2000-01-01"


class Client:
    """Tables under root: panel (date, date_idx, symbol as security_id, fields), master, calendar, universe."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.storage = spark, Storage(spark, root)

    def _table(self, name: str) -> DataFrame:
        if not self.storage.exists(name):
            raise ConfigurationError(f"no table {name} under {self.storage.root}")
        return self.storage.scan_parquet(name)

    @property
    def master(self) -> SecurityMaster:
        return SecurityMaster(self._table("master"))

    @property
    def calendar(self) -> TradingCalendar:
        return TradingCalendar(self._table("calendar"))

    def universe(self, name: str = "universe") -> list[str]:
        return [r[0] for r in self._table(name).select("symbol").distinct().orderBy("symbol").collect()]

    def lookup(self, identifier: str, as_of: dt.date | str | None = None) -> Row | None:
        return self.master.resolve(identifier, as_of)

    def build_fields(self, ticks: DataFrame, filed: DataFrame | None = None, names: set[str] | None = None, overwrite: bool = False) -> bool:
        """Writes the panel of fields, unless it is there."""
        panel = build(self._table("calendar"), ticks, filed, self._table("master").withColumn("symbol", F.col("security_id").cast("string")) if self.storage.exists("master") else None, names)
        return self.storage.build(panel.df, "panel", overwrite)

    def panel(self, names: Sequence[str], symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> Panel:
        """Fields of some symbols (default: the universe, or all) between two dates; only these columns are read.

        Identifiers are resolved as of start; what is returned is named as it was asked for."""
        if unknown := set(names) - set(FIELDS) - set(self._table("panel").columns):
            raise UnknownFieldError(", ".join(sorted(unknown)))
        df = self._table("panel").select("date", "date_idx", "symbol", *names)
        if symbols is None and self.storage.exists("universe"):
            symbols = self.universe()
        if symbols is not None:
            asked = self.spark.createDataFrame([(str(s),) for s in symbols], "identifier string")
            ids = self.master.resolve_batch(asked, start).filter("security_id IS NOT NULL").select("identifier", F.col("security_id").cast("string").alias("symbol"))
            df = df.join(ids, "symbol").drop("symbol").withColumnRenamed("identifier", "symbol")
        return Panel(df.select("date", "date_idx", "symbol", *names)).between(start, end)

    def get(self, field: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The matrix of one field."""
        return self.panel([field], symbols, start, end).to_wide(field)

    def query(self, formula: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """A formula over the fields that it names, and no others."""
        names = sorted(field_refs(formula))
        return compute(formula, self.panel(names, symbols, start or FIRST_DAY, end or (dt.date.today() - dt.timedelta(days=1)).isoformat()))
