"""The thin queries of this subpackage: each applies one operator to a whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontamination import find_leaks
from tessera.llm.langid import identify
from tessera.llm.mixing import mix
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.pii import find
from tessera.llm.progressive_jpeg import digests, store_column
from tessera.llm.quality import classify
from tessera.llm.resharding import through_files
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.warc import round_trip


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 80 % alike."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when repeated windows of 20 words go."""
    return remove_repeats(table(spark, sf_dir, "documents"), size=20).drop("kept_text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of 150 % of all words; sources weigh 5, 2, 1 and are read twice at most."""
    return mix(table(spark, sf_dir, "documents")).drop("times")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by the salvage reader."""
    return round_trip(table(spark, sf_dir, "pages"))


def old_layout(shards: int = 16):
    """The layout that op5 starts from: a source lies in one shard, so shards are as uneven as sources."""
    return F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(shards))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards laid out by source to 24 of equal row counts, in files, read back from the new ones."""
    return through_files(table(spark, sf_dir, "documents"), old_layout(), 24)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in the coefficients of a progressive JPEG, and read back."""
    return digests(store_column(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by strict patterns, and spans that weak supervision adds."""
    return find(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from two thirds of the labels."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    return identify(table(spark, sf_dir, "documents"))


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item, in whatever order."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_langid": op3_langid,
    "op4_tiling": op4_tiling,
    "op5_resharding": op5_resharding,
    "op6_minhash": op6_minhash,
    "op7_jpeg": op7_jpeg,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_substring": op10_substring,
}

#: The white space that ends a word, for DuckDB.
_GAP = r"'[\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[i * 5 + 1:i * 5 + 5])::INT >> (15 - 5 * j)::INT) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op6_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_GAP}), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op8_mixing": rf"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS a,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), {_GAP}), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER () * 150)::DOUBLE / 100.0::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT level FROM l WHERE weight * level < cap ORDER BY ratio, k LIMIT 1),
t AS (SELECT k, source_size, CASE WHEN weight * level >= cap THEN cap::DOUBLE ELSE weight * (SELECT level FROM o) END AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY k ORDER BY a, size ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN whole < 2 AND 2 * run - size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN f USING (k)""",
    "op10_substring": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_GAP}), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
c AS (SELECT x.doc_id, x.i, x.x, max(r.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NULL AS kept
  FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE NOT kept) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE kept) AS t FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)""",
}
