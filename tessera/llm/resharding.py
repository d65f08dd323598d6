"""Resharding by minimum-cost flow (operator 5).

Old shards are cut into blocks by size class. A flow network carries rows from blocks to new shards: staying at home is
free, moving costs a block's mean bytes a row, and capacities make row counts at most one apart. Its solution says how
many rows each block sends where; of a block that moves in part the smallest rows move, so that the fewest bytes do, but
for the choice of which shards hold a row more, which goes by mean bytes. The network holds
old shards x 40 classes at most, whatever the number of rows; only those sums reach the driver.

Rows of a block are numbered in parallel, by size: by size and hash into sub-blocks, by prefix sums of their counts (a
row per distinct size), and within each."""

from __future__ import annotations

import heapq
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, shared_path

#: Rows of a sub-block, about.
SUB_ROWS = 20_000
#: Bytes of text in a rewritten file, about, at scale.
FILE_BYTES = 32 << 20


class Move(NamedTuple):
    """Rows lo to hi (exclusive) of a block go to shard, where they take the slots from slot on."""

    old: int
    kind: int
    lo: int
    hi: int
    shard: int
    slot: int


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int]:
    """(flow on each arc, cost) of a maximum flow of least cost; arcs: (from, to, capacity, cost >= 0).

    Successive shortest paths with potentials."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(k), cost.append(v)
    height, total = [0] * n, 0
    while True:
        far, by = [None] * n, [-1] * n
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] > 0 and (far[to[e]] is None or d + cost[e] + height[x] - height[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + height[x] - height[to[e]]
                    by[to[e]] = e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))], total
        height = [h + (far[i] if far[i] is not None else 0) for i, h in enumerate(height)]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        much = min(cap[e] for e in path)
        for e in path:
            cap[e] -= much
            cap[e ^ 1] += much
            total += much * cost[e]


def solve(blocks: list[tuple[int, int, int, int]], shards: int) -> tuple[list[Move], int]:
    """(moves, estimated bytes moved) for blocks of (old shard, class, rows, bytes)."""
    blocks = sorted(blocks)
    rows = sum(b[2] for b in blocks)
    base, more = divmod(rows, shards)
    k = len(blocks)
    source, sink, pool, extra, first = k, k + 1, k + 2, k + 3, k + 4
    arcs = [(source, i, b[2], 0) for i, b in enumerate(blocks)]
    home = {}
    for i, b in enumerate(blocks):
        if 0 <= b[0] < shards:
            home[i] = len(arcs)
            arcs.append((i, first + b[0], b[2], 0))
    away = len(arcs)
    arcs += [(i, pool, b[2], -(-b[3] // max(1, b[2]))) for i, b in enumerate(blocks)]
    into = len(arcs)
    arcs += [(pool, first + s, rows, 0) for s in range(shards)]
    arcs += [(first + s, sink, base, 0) for s in range(shards)] + [(first + s, extra, 1, 0) for s in range(shards)] + [(extra, sink, more, 0)]
    flow, cost = min_cost_flow(first + shards, arcs, source, sink)
    moves, slot = [], [0] * shards
    wanted = [(s, flow[into + s]) for s in range(shards) if flow[into + s]]

    def put(i: int, lo: int, n: int, s: int) -> None:
        moves.append(Move(blocks[i][0], blocks[i][1], lo, lo + n, s, slot[s]))
        slot[s] += n

    for i in range(k):
        at = 0
        if i in home and flow[home[i]]:
            put(i, 0, at := flow[home[i]], blocks[i][0])
        left = flow[away + i]
        while left:
            s, room = wanted[0]
            put(i, at, n := min(left, room), s)
            at, left = at + n, left - n
            wanted[:1] = [(s, room - n)] if room > n else []
    return moves, cost


def reshard(docs: DataFrame, old_shard: Column, shards: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved for each row of docs (doc_id, text).

    old_shard is an int expression over docs; null counts as shard 0. size: UTF-8 bytes of the text and 8; a null text
    has none, and the checksum of nothing. Row counts of shards differ by one at most (law `rows`), also with fewer rows
    than shards; slots run gapless from 0. Rows that repeat a doc_id are separate rows; which of equal rows gets which
    slot is open. Equal texts may part. An empty table gives no rows. Extra columns are ignored unless kept."""
    out = _placed(cut(_rows(docs, old_shard, keep), "rows"), shards)
    return out.select(*(F.col(c).alias(c.removeprefix("kept_")) for c in out.columns))


def _measured() -> tuple[Column, Column]:
    """size and text_crc32 of the column text."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")


def _rows(docs: DataFrame, old_shard: Column, keep: tuple[str, ...]) -> DataFrame:
    rows = docs.select("doc_id", *_measured(), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    return rows.withColumn("kind", F.length(F.bin("size")))


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """The result of reshard(), kept columns under kept_ and their names. rows are read more than once, so they need to be in files."""
    blocks = rows.groupBy("old_shard", "kind").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    moves, _ = solve([tuple(b) for b in blocks], shards)
    # numbered from the largest row down, so that the rows that stay, which come first, are the largest
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(64, max((b["rows"] for b in blocks), default=0) // SUB_ROWS))))
    keys = ["old_shard", "kind", "size", "sub"]
    counts = rows.groupBy(*keys).count()
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    larger = counts.groupBy("old_shard", "kind", "size").agg(F.sum("count").alias("count"))
    larger = larger.select("old_shard", "kind", "size", F.coalesce(F.sum("count").over(before("old_shard", "kind").orderBy(F.desc("size"))), F.lit(0)).alias("larger"))
    ahead = counts.select(*keys, F.coalesce(F.sum("count").over(before("old_shard", "kind", "size").orderBy("sub")), F.lit(0)).alias("ahead"))
    ahead = ahead.join(larger, ["old_shard", "kind", "size"]).select(*keys, (F.col("ahead") + F.col("larger")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("place", place).join(ahead, keys).withColumn("place", F.col("place") + F.col("ahead"))
    # one row per block, of a bounded number: old shards x size classes
    by_block: dict[tuple[int, int], list] = {}
    for m in moves:
        by_block.setdefault((m.old, m.kind), []).append((m.lo, m.hi, m.shard, m.slot))
    plan = rows.sparkSession.createDataFrame([(*k, v) for k, v in by_block.items()], "old_shard int, kind int, parts array<struct<lo: long, hi: long, to: int, slot: long>>")
    out = out.join(F.broadcast(plan), ["old_shard", "kind"])
    part = F.filter("parts", lambda x: (x["lo"] <= F.col("place")) & (F.col("place") < x["hi"]))[0]
    out = out.withColumn("part", part)
    out = out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.to").alias("shard"), (F.col("part.slot") + F.col("place") - F.col("part.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("old_shard") != F.col("part.to")).alias("moved"), *(c for c in rows.columns if c.startswith("kept_")))
    return out


def _cuts(rows: DataFrame, moves: list[Move], subs: int) -> list[tuple[tuple[int, int], tuple, int]]:
    """(block, smallest key, shard) of every part of a block, in order: where it starts, and where it goes.

    Only the cells (equal size, equal hash) that a part starts in are ordered, some SUB_ROWS rows each; one row a part
    reaches the driver, so no more than blocks and shards together."""
    spark, keys = rows.sparkSession, ["old_shard", "kind", "size", "sub"]
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).count()
    larger = counts.groupBy("old_shard", "kind", "size").agg(F.sum("count").alias("all"))
    larger = larger.select("old_shard", "kind", "size", F.coalesce(F.sum("all").over(before("old_shard", "kind").orderBy(F.desc("size"))), F.lit(0)).alias("larger"))
    ahead = counts.select(*keys, "count", F.coalesce(F.sum("count").over(before("old_shard", "kind", "size").orderBy("sub")), F.lit(0)).alias("ahead"))
    ahead = ahead.join(larger, ["old_shard", "kind", "size"]).select(*keys, "count", (F.col("ahead") + F.col("larger")).alias("ahead"))
    wanted = spark.createDataFrame([(m.old, m.kind, m.lo) for m in moves if m.lo], "old_shard int, kind int, lo long")
    cells = ahead.join(F.broadcast(wanted), ["old_shard", "kind"]).filter("ahead <= lo AND lo < ahead + count").select(*keys, "lo", (F.col("lo") - F.col("ahead")).alias("nth"))
    nth = F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("doc_id", "text_crc32", "file", "at")) - 1
    found = rows.join(F.broadcast(cells), keys).withColumn("n", nth).filter("n = nth").collect()
    start = {(r.old_shard, r.kind, r.lo): (-r["size"], r["sub"], r.doc_id, r.text_crc32, r.file, r.at) for r in found}
    return [((m.old, m.kind), start[m.old, m.kind, m.lo] if m.lo else (-(1 << 62), 0, None, 0, "", 0), m.shard) for m in moves]


def rewrite_files(docs: DataFrame, path: str, shards: int = 24) -> list[int]:
    """Brings a table of folders shard=N under path, which docs reads, to the new layout; writes only folders of shards
    that lose or gain rows, and returns their numbers. A folder that loses all rows goes.

    Rows are ordered within a block by size, hash, id and place in the files; the flow's parts of a block are ranges of that
    order, so a row's new shard follows from comparisons with the ranges' starts, and texts are read and written but
    not shuffled. All new folders are written beside path first, in one pass, and then take the places of the old ones one
    by one."""
    spark = docs.sparkSession
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    old = F.coalesce(F.col("shard").cast("int"), F.lit(0))
    narrow = cut(docs.select("doc_id", *_measured(), old.alias("old_shard"), *at).withColumn("kind", F.length(F.bin("size"))), "rows")
    blocks = narrow.groupBy("old_shard", "kind").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    moves, _ = solve([tuple(b) for b in blocks], shards)
    touched = sorted({s for m in moves if m.old != m.shard for s in (m.old, m.shard)})
    if not touched:
        forget(narrow)
        return touched
    subs = max(64, max(b["rows"] for b in blocks) // SUB_ROWS)
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs))
    parts: dict[tuple[int, int], list] = {}
    for block, key, shard in _cuts(narrow.withColumn("sub", sub), moves, subs):
        parts.setdefault(block, []).append((*key, shard))
    forget(narrow)
    plan = spark.createDataFrame([(*k, v) for k, v in parts.items()], "_old int, _kind int, _parts array<struct<less: long, sub: long, doc_id: long, crc: long, file: string, at: long, to: int>>")
    size, crc = _measured()
    rows = docs.select("*", old.alias("_old"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"), size.alias("_size"), crc.alias("_crc"))
    rows = rows.withColumn("_kind", F.length(F.bin("_size"))).join(F.broadcast(plan), ["_old", "_kind"])
    own = F.struct((-F.col("_size")).alias("less"), F.pmod(F.xxhash64("doc_id", "_crc"), F.lit(subs)).cast("long").alias("sub"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_crc").alias("crc"), F.col("_file").alias("file"), F.col("_at").alias("at"))
    mine = F.filter("_parts", lambda p: F.struct(*(p[c].alias(c) for c in ("less", "sub", "doc_id", "crc", "file", "at"))) <= own)
    rows = rows.withColumn("shard", F.element_at(mine, -1)["to"]).select(*docs.columns).filter(F.col("shard").isin(touched))
    # each task writes a file a shard, so a task reads as much as makes files of FILE_BYTES
    tasks = max(2 * spark.sparkContext.defaultParallelism, sum(b["bytes"] for b in blocks) // (shards * FILE_BYTES))
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.coalesce(tasks).write.partitionBy("shard").parquet(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in touched:
        was, new = at(f"{path}/shard={s}"), at(f"{fresh}/shard={s}")
        fs.delete(was, True)
        if fs.exists(new) and not fs.rename(new, was):
            raise OSError(f"{new.toString()} can't be renamed")
    fs.delete(at(fresh), True)
    return touched


def read_layout(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table of folders shard=N under path, with shard and slot: their places in the shard's files, by name."""
    rows = spark.read.schema(f"{schema}, shard int").parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    ahead = rows.groupBy("shard", "_file").count().select("shard", "_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    return rows.join(F.broadcast(ahead), ["shard", "_file"]).withColumn("slot", F.col("_ahead") + F.col("_at")).drop("_file", "_at", "_ahead")


def through_files(docs: DataFrame, old_shard: Column, shards: int = 24) -> DataFrame:
    """The columns of reshard(), taken from files: docs are laid out in folders by old_shard (an expression over docs that
    gives the same for a row at any time) in the shared folder, brought to the new layout and read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "shards")
    docs = docs.drop("shard", "slot")
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    rewrite_files(spark.read.schema(f"{schema}, shard int").parquet(path), path, shards)
    out = read_layout(spark, path, schema).withColumn("old_shard", old)
    return out.select("doc_id", *_measured(), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("old_shard") != F.col("shard")).alias("moved"))
