"""Filed figures: merging tags, one value for each frame, and quarters that only the annual figure implies.

facts: symbol, tag, val, start, end, filed (dates as ISO text or dates), accn, form, frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_tags(facts: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """facts with concept: every tag of a concept counts, in the order of the mapping; of rows that share accession, frame
    and filing date, that of the first tag stays."""
    spark = facts.sparkSession
    rows = [(c, t, i) for c, tags in mapping.items() for i, t in enumerate(tags)]
    tags = spark.createDataFrame(rows, "concept string, tag string, priority int")
    joined = facts.join(F.broadcast(tags), "tag")
    first = Window.partitionBy("symbol", "concept", "accn", "frame", "filed").orderBy("priority", "val")
    return joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "priority")


def quarterly(facts: DataFrame) -> DataFrame:
    """Duration figures per quarter: of each frame the latest filed; quarters as they are; the fourth quarter as the annual
    figure less the three others of its year, starting the day after the third ends. Annual figures of years that
    lack a quarter are left out, as are rows without start, end, filing date or frame.

    facts need key columns symbol and concept beside their own."""
    rows = facts.filter("start IS NOT NULL AND end IS NOT NULL AND filed IS NOT NULL AND frame IS NOT NULL")
    rows = rows.withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date"), "filed": F.col("filed").cast("date"), "_year": F.substring("frame", 3, 4).cast("int")})
    # of equal filing dates the first accession stays
    latest = Window.partitionBy("symbol", "concept", "frame").orderBy(F.col("filed").desc(), "accn", "val")
    rows = rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    year = Window.partitionBy("symbol", "concept", "_year")
    quarter = F.regexp_extract("frame", r"Q([1-4])", 1)
    one = lambda q, c: F.min_by(F.when(quarter == q, F.col(c)), F.when(quarter == q, F.struct(F.length("frame"), F.col("frame")))).over(year)
    rows = rows.withColumns({"_q": quarter, **{f"_q{q}": one(q, "val") for q in "123"}, "_e3": one("3", "end")})
    implied = (F.col("_q") == "") & F.col("_q1").isNotNull() & F.col("_q2").isNotNull() & F.col("_q3").isNotNull()
    rows = rows.filter((F.col("_q") != "") | implied)
    val = F.when(F.col("_q") == "", F.col("val").cast("double") - F.col("_q1") - F.col("_q2") - F.col("_q3")).otherwise(F.col("val").cast("double"))
    start = F.when(F.col("_q") == "", F.date_add("_e3", 1)).otherwise(F.col("start"))
    return rows.withColumns({"val": val, "start": start}).select(*facts.columns)


def as_filed(facts: DataFrame, concept_values: tuple[str, ...] | None = None) -> DataFrame:
    """symbol, date (of filing), concept, value: of several figures of a day, that of the latest end, then accession."""
    if concept_values:
        facts = facts.filter(F.col("concept").isin(*concept_values))
    return facts.groupBy("symbol", F.col("as_of_date").cast("date").alias("date"), "concept").agg(F.max_by("value", F.struct("end", "accn", "value")).alias("value"))
