"""A corpus pipeline of five stages: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one more; each
result is written as Parquet in the shared folder and read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, minhash_dedup, mixing, quality, resharding
from tessera.llm.common import cut, forget, scratch, table

SHARDS = 24


def _held(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but doc_id and text under names that no operator uses, and which column is under which name."""
    names = {c: c if c in ("doc_id", "text") else f"held_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _back(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for c, n in names.items()), *(m for m in more if m not in names))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.5). Labels come from sf_dir/labels."""
    held, names = _held(docs)
    model = quality.fit(docs, quality.learn_from(table(spark, sf_dir, "labels")))
    return _back(quality.score(held, model, keep=tuple(names.values())).filter("score >= 0.5"), names)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five-word shingles, 80 %).

    Documents without words are not duplicates of anything and stay, as do rows with a null doc_id."""
    found = minhash_dedup.near_duplicates(docs, k=5, percent=80)
    drop = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold most of an item of sf_dir/benchmark."""
    held, names = _held(docs)
    found = decontamination.find_leaks(held, table(spark, sf_dir, "benchmark"), keep=tuple(names.values()))
    return _back(found.filter(~F.col("contaminated")), names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as often as the mix takes them: not at all, once or twice."""
    held, names = _held(docs)
    keep = tuple(n for n in names.values() if n != "doc_id")
    mixed = mixing.mix(held.withColumn("source", F.col(names["source"])), keep=keep)
    return _back(mixed.filter("times > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))), names)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all rows in SHARDS shards of equal row counts, moving the fewest bytes from a layout by source.

    A column of docs that is named shard, slot or moved stays, in place of the result of that name."""
    held, names = _held(docs)
    source = F.pmod(F.crc32(F.coalesce(F.col(names["source"]), F.lit("")).cast("binary")), F.lit(16))
    keep = tuple(n for n in names.values() if n != "doc_id")
    return _back(resharding.reshard(held, source, SHARDS, keep=keep), names, "shard", "slot", "moved")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Stages fit models and confirm candidates, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            kept = cut(stage(spark, docs, sf_dir), f"stage{i}")
            made.remove(kept.cut_path)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
