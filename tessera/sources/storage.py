"""Tables by path: Parquet, Arrow files, CSV and text, with existence checks through Spark's own file systems."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.plans.errors import StorageError


class Storage:
    """Tables under one root, which may be on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def scan_parquet(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A plan; only the columns asked for are read."""
        if not self.exists(name):
            raise StorageError(f"no table at {self.path(name)}")
        df = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def read_parquet(self, name: str, columns: Sequence[str] | None = None, filters: Sequence[Column] = ()) -> DataFrame:
        """Filters reach the scan."""
        df = self.scan_parquet(name)
        for f in filters:
            df = df.filter(f)
        return df.select(*columns) if columns else df

    def scan_ipc(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Arrow IPC files (one, or all of a folder): each is read by one task, and its batches are handed on as they are.

        The schema is taken from the first file's footer, read through Spark."""
        files = self.spark.read.format("binaryFile").load(self.path(name))
        first = files.orderBy("path").select("content").first()
        if first is None:
            raise StorageError(f"no Arrow file at {self.path(name)}")
        from pyspark.sql.pandas.types import from_arrow_schema

        schema: StructType = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(first["content"])).schema)
        keep = list(columns) if columns else schema.fieldNames()
        schema = StructType([schema[c] for c in keep])

        def run(batches):
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    reader = pa.ipc.open_file(pa.BufferReader(data))
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i).select(keep)

        return files.select("content").mapInArrow(run, schema)

    read_ipc = scan_ipc

    def read_csv(self, name: str, schema: str, sep: str = ",") -> DataFrame:
        return self.spark.read.schema(schema).csv(self.path(name), header=True, sep=sep)

    def read_text(self, name: str) -> DataFrame:
        return self.spark.read.text(self.path(name))

    def write_parquet(self, df: DataFrame, name: str, partition_by: Sequence[str] = (), overwrite: bool = True) -> None:
        df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by).parquet(self.path(name))

    def write_text(self, df: DataFrame, name: str) -> None:
        """A table of one string column as lines."""
        df.write.mode("overwrite").text(self.path(name))

    def build(self, df: DataFrame, name: str, overwrite: bool = False) -> bool:
        """Writes df unless the table is there; whether it was written."""
        if not overwrite and self.exists(name):
            return False
        self.write_parquet(df, name)
        return True
