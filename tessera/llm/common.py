"""Shared helpers: reading tables, cutting lineage through shared storage, hashing splits."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch handed to Python; whole documents, so kept small. A row of more bytes is a batch alone.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder the caller set on the context.

    A local master has one machine, so there a temporary folder serves where neither is set; elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, every shared path that was made within, but those taken out of the list that it gives."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables that cut() made and that nothing will read again; other tables are left alone."""
    for t in tables:
        if path := vars(t).get("cut_path"):
            remove(t.sparkSession, path)


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """rows join small, which has one row a key, dealt over salts: rows of one key are read by so many tasks."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns if c not in on)), F.lit(salts)).cast("int")
    return rows.withColumn("salt", dealt).join(salted, [*on, "salt"], how).drop("salt")


#: Bits of the filter that only() broadcasts: 16 MB, whatever the number of ids.
FILTER_BITS = 1 << 27


def only(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of docs (doc_id long, text and more) whose doc_id is surely none of ids (doc_id) are left out, before a join
    has to move their texts; some others may stay. The filter is a bitmap of a fixed size: if there are many more ids
    than bits it leaves everything in, which costs time only."""
    spark, part = docs.sparkSession, 1 << 15
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(cell.alias("cell")).groupBy(F.floor(F.col("cell") / part).alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % part).alias("bits")).collect()
    held = np.zeros((bits // part, part // 8), np.uint8)
    for r in rows:
        held[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(held.reshape(-1))

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if hit.any():
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(hit))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.filter("doc_id IS NOT NULL").select(cell.alias("_cell"), *docs.columns).mapInArrow(run, schema)


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text, unsigned."""
    return F.crc32(col.cast("string").cast("binary"))


def spread(seed: int, *cols: Column) -> Column:
    """A seeded hash in [0, 1) that is the same in every run and layout."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def bounded_sample(labelled: DataFrame, label: str, per_class: int, seed: int = 7) -> DataFrame:
    """About per_class rows of each label value (all of a rarer one), chosen by a seeded hash of doc_id.

    Counts of the classes are joined to the rows, which are then kept by a threshold on their hash, so nothing reaches the
    driver and no class is gathered into one task. The expected size is classes x per_class, a documented bound of the fit."""
    counts = cut(labelled.groupBy(label).agg(F.count("*").alias("_n")), "classes")
    return labelled.join(counts, label).filter(spread(seed, F.col("doc_id")) * F.col("_n") < per_class).select(labelled.columns)
