"""Choosing tags for concepts: samples of companies and filings, tag usage, and suggestions by likeness of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of tag names that mark structure, those that mark breakdowns, and words that speak for a concept:
#: of each list all must occur in the label or in the tag.
STRUCTURE = ("axis", "member", "domain", "table", "lineitems")
BREAKDOWN = ("segment", "geograph", "disaggregation", "breakdown", "concentration")
KEYWORDS = {
    "revenue": [["revenue"], ["sales"]],
    "net_income": [["net", "income"], ["profit", "loss"]],
    "operating_income": [["operating", "income"]],
    "gross_profit": [["gross", "profit"]],
    "cost_of_revenue": [["cost", "revenue"], ["cost", "goods"]],
    "assets": [["assets"]],
    "liabilities": [["liabilities"]],
    "cash_and_cash_equivalents": [["cash", "equivalents"]],
    "operating_cash_flow": [["net", "cash", "operating"]],
    "capital_expenditures": [["capital", "expenditures"], ["purchase", "property", "equipment"]],
}


def latest_fact(facts: DataFrame) -> DataFrame:
    """symbol, tag, val: of each the value of the latest end, then fiscal year, over all units."""
    return facts.groupBy("symbol", "tag").agg(F.max_by("val", F.struct("end", "fy", "val")).alias("val"))


def stratified_sample(companies: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n of companies (symbol, size, industry), drawn in turn from strata of size thirds and industry, in a seeded order.

    Thirds are cut at exact percentiles; the order within a stratum is by hash, so a rerun draws the same."""
    cuts = companies.agg(F.percentile("size", F.array(F.lit(0.33), F.lit(0.66))).alias("cuts"))
    tier = F.when(F.col("size") <= F.col("cuts")[0], 0).when(F.col("size") <= F.col("cuts")[1], 1).otherwise(2)
    rows = companies.crossJoin(F.broadcast(cuts)).withColumn("tier", tier).drop("cuts")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), "symbol").cast("binary"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("tier", "industry").orderBy(draw, "symbol")))
    return rows.orderBy("turn", "tier", "industry", "symbol").limit(n)


def select_filings(filings: DataFrame, per_company: int, total: int) -> DataFrame:
    """The newest per_company filings (symbol, accn, filed) of each company, then the newest total of all."""
    newest = Window.partitionBy("symbol").orderBy(F.col("filed").desc(), "accn")
    return filings.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_company).drop("_n").orderBy(F.col("filed").desc(), "accn").limit(total)


def is_noise(tag: Column) -> Column:
    """Whether a tag, which may have a taxonomy's prefix, names structure, a breakdown or an identifier of the filing."""
    return F.lower(tag).rlike("|".join((*STRUCTURE, *BREAKDOWN))) | F.lower(tag).rlike("^(srt|dei):")


def tag_usage(facts: DataFrame) -> DataFrame:
    """tag, filings (in how many it occurs), label (the smallest), without noise."""
    seen = facts.filter(~is_noise(F.col("tag"))).groupBy("accn", "tag").agg(F.min("label").alias("label"))
    return seen.groupBy("tag").agg(F.count("*").alias("filings"), F.min("label").alias("label"))


def _words(c: Column) -> Column:
    """The lower-case words of a name, as white space parts them."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def token_set_ratio(a: list[str], b: list[str]) -> float:
    """0 to 100: the likeness of two sets of words that rapidfuzz has under this name.

    100 if one set holds the other; else the best of comparing the shared words with both sets and the sets with each
    other, by insertions and deletions in the sorted words joined by spaces."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (shared == x or shared == y):
        return 100.0
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    run = [0] * (len(q) + 1)  # longest common subsequences
    for c in p:
        last = 0
        for k, d in enumerate(q, 1):
            last, run[k] = run[k], last + 1 if c == d else max(run[k], run[k - 1])
    both, gap = len(" ".join(shared)), int(bool(shared))
    ratio = lambda apart, of: 100.0 - 100.0 * apart / of
    out = ratio(len(p) + len(q) - 2 * run[-1], 2 * (both + gap) + len(p) + len(q))
    return max(out, *(ratio(gap + len(z), 2 * both + gap + len(z)) for z in (p, q))) if shared else out


def likeness(a: Column, b: Column) -> Column:
    """0 to 100: the token-set ratio of two names; 0 if one is null."""
    words = lambda c: F.coalesce(_words(c), F.array().cast("array<string>"))
    return F.udf(token_set_ratio, "double")(words(a), words(b))


def _boost(concept: Column, label: Column, tag: Column) -> Column:
    """10 for every keyword list of the concept that label or tag holds as a whole."""
    out = F.lit(0)
    for name, lists in KEYWORDS.items():
        for words in lists:
            within = lambda c, words=words: reduce(lambda a, b: a & b, (F.lower(c).contains(w) for w in words))
            out = out + F.when((concept == name) & (F.coalesce(within(label), F.lit(False)) | within(tag)), 10).otherwise(0)
    return out


def suggest(concepts: DataFrame, usage: DataFrame, most_used: int = 400, least: float = 65.0, keep: int = 8) -> DataFrame:
    """concept, tag, score, filings: for each of concepts (concept, description) the best of the most used tags.

    score: three quarters likeness to the label, a quarter to the tag, rounded down, 10 more for each list of keywords, 30
    less for structure. Likeness is the token-set ratio. Concepts and the most_used tags are a few hundred rows each, whatever the filings."""
    tags = usage.orderBy(F.col("filings").desc(), "tag").limit(most_used)
    both = concepts.crossJoin(F.broadcast(tags))
    score = F.floor(0.75 * likeness(F.col("description"), F.col("label")) + 0.25 * likeness(F.col("concept"), F.col("tag"))) + _boost(F.col("concept"), F.col("label"), F.col("tag")) - F.when(F.lower("tag").rlike("|".join(STRUCTURE)), 30).otherwise(0)
    best = Window.partitionBy("concept").orderBy(F.col("filings").desc(), F.col("score").desc(), "tag")
    return both.withColumn("score", score).filter(F.col("score") >= least).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).select("concept", "tag", "score", "filings")


def mapped(c: Column, mapping: dict[str, str]) -> Column:
    """c through a small fixed mapping, null where it has no entry."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[c]


def publish(facts: DataFrame, path: str) -> dict:
    """Replaces a table of filed figures and returns what it holds: rows, distinct concepts, the latest date."""
    facts.write.mode("overwrite").parquet(path)
    r = facts.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.countDistinct("concept").alias("concepts"), F.max("as_of_date").alias("latest")).first()
    return r.asDict()
