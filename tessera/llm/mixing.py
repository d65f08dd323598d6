"""Mixing sources to target weights by capped water-filling (operator 8), in DataFrame functions only.

Targets: the budget is dealt by weight; a source that would exceed max_epochs times its size stops there, and the
excess goes to the others by weight until none is above. Sorted by limit per weight, the stopped sources are a prefix,
so prefix sums over one row per source solve it without iterating.

Sampling: a source whose target is q.f times its size takes each document q times, and a fraction f of its words once
more: documents stand in a seeded order, and those whose middle word lies before the mark are taken. The order is cut
into blocks by hash, so the running sums of a source are spread over many tasks, however large the source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Rows of one source in a block, about.
BLOCK_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    gaps = r"[\x20\x09-\x0D]+"
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{gaps}|{gaps}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, gaps))).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, max_epochs: int) -> DataFrame:
    """Adds target to one row per source (key, source_size); weights repeat over the sources in key order."""
    each = F.array(*(F.lit(w).cast("long") for w in weights))
    place = F.row_number().over(Window.orderBy("key")) - 1
    df = sizes.withColumn("weight", F.element_at(each, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    df = df.withColumn("limit", max_epochs * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    whole = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * percent / 100.0 - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", left / weight_left)
    df = df.withColumn("stopped", F.col("weight") * F.col("level") >= F.col("limit"))
    # the level of the first source that is not stopped holds for all of those
    level = F.first(F.when(~F.col("stopped"), F.col("level")), ignorenulls=True).over(whole)
    return df.select("key", "source_size", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, max_epochs: int = 2, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, times, taken for each row of docs (doc_id, text, source), with the columns of keep.

    size counts words. A null source is one of its own, ordered last. Empty texts have size 0 and cost nothing when
    taken. Sources without words get target 0. Rows that repeat a doc_id stand next to each other in the order and
    count apart. An empty table gives no rows. Extra columns are ignored unless kept."""
    rows = docs.select("doc_id", word_count(F.col("text")).alias("size"), source_key(F.col("source")).alias("key"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = rows.withColumn("at", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = cut(rows, "sizes")
    totals = cut(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "totals")
    most = totals.agg(F.max("docs")).first()[0] or 1
    digits = max(2, min(6, math.ceil(math.log(max(1, most / BLOCK_ROWS), 16)) + 1))
    rows = rows.withColumn("block", F.substring("at", 1, digits))
    ahead = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("sum"))
    blocks = blocks.select("key", "block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    plan = targets(totals.drop("docs"), weights, percent, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    inside = Window.partitionBy("key", "block").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("run", F.sum("size").over(inside)).join(blocks.join(plan, "key"), ["key", "block"])
    more = (2 * (F.col("ahead") + F.col("run")) - F.col("size") < 2 * F.col("part")).cast("long")
    times = F.col("whole") + F.when(F.col("whole") < max_epochs, more).otherwise(F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *(F.col(f"kept_{c}").alias(c) for c in keep))
