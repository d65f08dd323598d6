"""A journal of formulas and their results, gated by correlation with what is already accepted.

Tables are Parquet folders that only grow: an acceptance or a removal is a row of marks, applied when a table is read, so
writers at the same time lose nothing of each other. A check sees what was written before it began."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.sources.storage import Storage

CORRELATION, IMPROVEMENT = 0.7, 10.0
SCHEMAS = {
    "alphas": "alpha_id string, name string, tags array<string>, created_at string",
    "versions": "version_id string, alpha_id string, formula string, sharpe double, status string, pnl array<struct<date: string, ret: double>>, created_at string",
    "correlations": "new_id string, version_id string, corr double, new_sharpe double, sharpe double, improvement double, passed boolean",
    "marks": "kind string, id string",
}


def check(new_pnl: DataFrame, new_sharpe: float, versions: DataFrame) -> DataFrame:
    """version_id, corr, new_sharpe, sharpe, improvement, passed for each of versions (version_id, sharpe, pnl).

    new_pnl: pos (from 0), ret. Series are aligned by position, to the shorter. A version passes if the correlation is under
    0.7 or the Sharpe ratio improves by 10 % or more; versions without figures, or of constant series (no correlation), are
    left out or pass as NaN does not: corr NaN never is under 0.7, so only the improvement can pass it."""
    old = versions.filter(F.col("sharpe").isNotNull() & (F.size("pnl") > 0)).select("version_id", "sharpe", F.posexplode("pnl").alias("pos", "p"))
    both = old.select("version_id", "sharpe", "pos", F.col("p.ret").alias("y")).join(new_pnl.select("pos", F.col("ret").alias("x")), "pos").filter("x IS NOT NULL AND y IS NOT NULL")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    corr = F.when((F.min("x") < F.max("x")) & (F.min("y") < F.max("y")), F.try_divide(F.covar_pop("x", "y"), spread)).otherwise(M.nan())
    out = both.groupBy("version_id", "sharpe").agg(corr.alias("corr"))
    s, new = F.col("sharpe"), F.lit(float(new_sharpe))
    gain = F.when(s == 0, F.when(new > 0, F.lit(M.INF)).otherwise(0.0)).otherwise(F.try_divide(new - s, s) * 100)
    return out.select("version_id", "corr", new.alias("new_sharpe"), "sharpe", gain.alias("improvement")).withColumn("passed", ((F.col("corr") < CORRELATION) & ~F.isnan("corr")) | (F.col("improvement") >= IMPROVEMENT))


class Journal:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Storage(spark, root)

    def _written(self, name: str) -> DataFrame:
        return self.store.scan_parquet(name) if self.store.exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _marked(self, kind: str, column: str) -> DataFrame:
        return self._written("marks").filter(F.col("kind") == kind).select(F.col("id").alias(column)).distinct()

    def table(self, name: str) -> DataFrame:
        """A table as it stands: without what was removed, and with what was accepted later."""
        df, gone = self._written(name), self._marked("deleted", "alpha_id")
        if name in ("alphas", "versions"):
            df = df.join(gone, "alpha_id", "left_anti")
        if name == "versions":
            forced = self._marked("submitted", "version_id").withColumn("_forced", F.lit(True))
            df = df.join(forced, "version_id", "left").withColumn("status", F.when(F.col("_forced"), "submitted").otherwise(F.col("status")))
        if name == "correlations":
            ids = self._written("versions").join(gone, "alpha_id", "left_semi").select("version_id")
            df = df.join(ids.withColumnRenamed("version_id", "new_id"), "new_id", "left_anti").join(ids, "version_id", "left_anti")
        return df.select(*self._written(name).columns)

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(self.store.path(name))

    def submit(self, name: str, formula: str, pnl: list[tuple[str, float]], sharpe: float, tags: list[str] = (), force: bool = False) -> tuple[str, bool, list]:
        """(version id, whether it was accepted, what blocks it): checked against all accepted versions, then recorded."""
        now = dt.datetime.now(dt.UTC).isoformat()
        accepted = self.table("versions").filter("status = 'submitted'")
        series = self.spark.createDataFrame([(i, r) for i, (_, r) in enumerate(pnl)], "pos int, ret double")
        results = check(series, sharpe, accepted).collect()
        blocking = [r for r in results if not r["passed"]]
        known = self.table("alphas").filter(F.col("name") == name).first()
        alpha = known["alpha_id"] if known else uuid.uuid4().hex
        if not known:
            self._append("alphas", [(alpha, name, list(tags), now)])
        version = uuid.uuid4().hex
        status = "submitted" if force or not blocking else "pending"
        self._append("versions", [(version, alpha, formula, float(sharpe), status, [(d, float(r)) for d, r in pnl], now)])
        if results:
            self._append("correlations", [(version, r["version_id"], r["corr"], r["new_sharpe"], r["sharpe"], r["improvement"], r["passed"]) for r in results])
        return version, status == "submitted", blocking

    def force_submit(self, version_id: str) -> None:
        self._append("marks", [("submitted", version_id)])

    def submitted(self) -> DataFrame:
        return self.table("versions").filter("status = 'submitted'").join(self.table("alphas").select("alpha_id", "name"), "alpha_id")

    def latest(self) -> DataFrame:
        """The newest version of each."""
        w = Window.partitionBy("alpha_id").orderBy(F.col("created_at").desc(), "version_id")
        return self.table("versions").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def correlations(self, version_id: str) -> DataFrame:
        return self.table("correlations").filter(F.col("new_id") == version_id)

    def delete(self, alpha_id: str) -> None:
        """Removes it, its versions and their correlations."""
        self._append("marks", [("deleted", alpha_id)])
