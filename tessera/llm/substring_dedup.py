"""Exact removal of repeated word windows behind a count-min prefilter (operator 10).

First pass: every partition sketches how often its windows may occur, the sketches are merged in a tree, and the
merged cells that say "twice or more" are broadcast. Second pass: only windows estimated as repeated are emitted and
grouped exactly, so none is lost; a full sketch costs time, never results. The sketch is sized by the bytes of the corpus
up to a bound of memory; beyond it both passes are made several times, over ranges of the hash.

To keep the sketch small against the corpus, a window is counted under its smallest GRAM-word run: equal windows hold
it at the same offset, so at different places in the corpus, and its count can only overestimate the window's."""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, tune
from tessera.llm.words import Words, as_long, chunks, mix, spans_hash

GRAM = 8
#: Rows of the sketch, and the parts that each is merged in.
DEPTH, SEGMENTS = 2, 256
#: Bytes of text for which a row has a cell, in one pass and at least in several; texts hold a smallest run in 40 bytes.
CELL_BYTES, TURN_BYTES = 10, 20
#: Cells of a row, least and most: two bits a cell while merging, one when broadcast, so 128 MB for both rows at most.
LEAST_WIDTH, MOST_WIDTH = 1 << 20, 1 << 29
#: Passes over ranges of the hash, at most, where a row of MOST_WIDTH is too small for all runs.
PASSES = 8
#: Smallest runs that a task counts at once.
COUNTED = 2_000_000
#: Repeated windows held by a task before those it has seen earlier itself are set aside.
HELD = 1_000_000
LAST = (1 << 63) - 1


def window_minima(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, hash of its smallest run, position of that run; the leftmost of equal ones)."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(GRAM, size)
    at = np.flatnonzero(w.doc[: len(h) - size + 1] == w.doc[size - 1 :])
    low = spans_hash(h, np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
    where = np.arange(len(low))
    left, span = size - gram + 1, 1
    while span < left:
        step = min(span, left - span)
        less = low[step:] < low[:-step]
        low, where = np.where(less, low[step:], low[:-step]), np.where(less, where[step:], where[:-step])
        span += step
    return at, low[at], where[at]


class Plan(NamedTuple):
    """Cells of a sketch row (a power of two), passes, and the pass that this is."""

    width: int
    passes: int
    turn: int

    def mine(self, g: np.ndarray) -> np.ndarray:
        """Whether runs of these hashes belong to this pass."""
        return (mix(g, 29) >> np.uint64(32)) % np.uint64(self.passes) == np.uint64(self.turn) if self.passes > 1 else np.ones(len(g), bool)

    def cells(self, g: np.ndarray) -> list[np.ndarray]:
        return [(mix(g, 11 + r) & np.uint64(self.width - 1)).astype(np.int64) for r in range(DEPTH)]


def plans(size: int, least: int = LEAST_WIDTH, most: int = MOST_WIDTH, passes: int = PASSES) -> list[Plan]:
    """The passes for `size` bytes of text. Beyond passes x most cells the sketch fills up: more windows reach the exact
    pass, with the same result."""
    width = min(most, max(least, 1 << (size // CELL_BYTES).bit_length()))
    turns = max(1, min(passes, -(-size // (TURN_BYTES * width))))
    return [Plan(width, turns, i) for i in range(turns)]


def _planes(once: np.ndarray, twice: np.ndarray, size: int) -> tuple[bytes, bytes]:
    out = []
    for x in (once, twice):
        bits = np.zeros(size, bool)
        bits[x] = True
        out.append(np.packbits(bits).tobytes())
    return tuple(out)


SKETCH = "part int, cell_row int, segment int, once binary, twice binary"
_SPARSE = b"s"
_DENSE = b"d"


def _sketch(size: int, fan: int, plan: Plan):
    span = plan.width // SEGMENTS

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % fan
        found: list[np.ndarray] = []

        def emit():
            g = np.concatenate(found) if found else np.zeros(0, np.uint64)
            found.clear()
            out = []
            for r, c in enumerate(plan.cells(g)):
                u, n = np.unique(c, return_counts=True)
                bound = np.searchsorted(u, np.arange(SEGMENTS + 1) * span)
                for s in range(SEGMENTS):
                    x, k = u[bound[s] : bound[s + 1]] - s * span, n[bound[s] : bound[s + 1]]
                    if len(x) == 0:
                        continue
                    if len(x) * 4 < span // 8:
                        once, twice = (_SPARSE + y.astype(np.uint32).tobytes() for y in (x, x[k > 1]))
                    else:
                        once, twice = (_DENSE + y for y in _planes(x, x[k > 1], span))
                    out.append((part, r, s, once, twice))
            return _sketch_batch(out)

        total = 0
        for batch in batches:
            for _, _, w in chunks(batch.column(0)):
                h = w.hashes()
                _, _, where = window_minima(w, h, size)
                mark = np.zeros(len(h) + 1, bool)
                mark[where] = True
                p = np.flatnonzero(mark)
                g = spans_hash(h, p, np.minimum(p + min(GRAM, size), len(h)))
                found.append(g[plan.mine(g)])
                total += len(found[-1])
            if total > COUNTED:
                yield emit()
                total = 0
        yield emit()

    return run


def _sketch_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "cell_row", "segment", "once", "twice"])


def _open(x: bytes, span: int) -> np.ndarray:
    """The bits of one segment of span cells, eight to a byte."""
    if x[:1] == _DENSE:
        return np.frombuffer(x, np.uint8, offset=1).copy()
    bits = np.zeros(span, bool)
    bits[np.frombuffer(x, np.uint32, offset=1)] = True
    return np.packbits(bits)


def _merged(last: bool, span: int):
    """Merges sorted sketch rows of one key as a stream: two occurrences make "twice" also across partitions."""

    def run(batches):
        key, one, two = None, None, None

        def row():
            return _sketch_batch([(0 if last else key[0], key[1], key[2], _DENSE + one.tobytes(), _DENSE + two.tobytes())])

        for batch in batches:
            for p, r, s, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = (0 if last else p, r, s)
                a, b = _open(once, span), _open(twice, span)
                if k == key:
                    two |= b | (one & a)
                    one |= a
                else:
                    if key is not None:
                        yield row()
                    key, one, two = k, a, b
        if key is not None:
            yield row()

    return run


def repeated_cells(texts: DataFrame, size: int, plan: Plan) -> np.ndarray:
    """(DEPTH, width // 8) bytes: cells hit at least twice by the windows of all texts, of one pass."""
    span = plan.width // SEGMENTS
    rows = texts.mapInArrow(_sketch(size, 16, plan), SKETCH)
    keys = ["part", "cell_row", "segment"]
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_merged(False, span), SKETCH)
    rows = rows.repartition(n, *keys[1:]).sortWithinPartitions(*keys[1:]).mapInArrow(_merged(True, span), SKETCH)
    out = np.zeros((DEPTH, SEGMENTS, span // 8), np.uint8)
    for r in rows.select("cell_row", "segment", "twice").toLocalIterator():
        out[r.cell_row, r.segment] = np.frombuffer(r.twice, np.uint8, offset=1)
    return out.reshape(DEPTH, -1)


#: What a byte counts in the second hash of a word.
SECOND = np.random.default_rng(20240306).integers(0, 1 << 63, 256, dtype=np.uint64)
#: a and b: 96 bits of a window's hashes, by two hashes of its words; 10^12 windows share one with probability under 10^-5.
REPEATS = "a long, b int, doc_id long, start int, len int, sure boolean"


def _candidates(size: int, sketch, plan: Plan):
    def run(batches):
        bits = sketch.value
        held: list[list[np.ndarray]] = []

        def flush():
            if not held:
                return
            a, b, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start = a[order], b[order], doc[order], start[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            first = (doc == doc[head]) & (start == start[head])  # rows that repeat a doc_id are one document
            for i in range(0, len(a), 100_000):
                f = np.flatnonzero(first[i : i + 100_000]) + i
                yield _repeat_batch(a[f], b[f], doc[f], start[f], np.ones(len(f), np.int32), False)
            doc, start = doc[~first], start[~first]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            if len(doc):
                edge = np.ones(len(doc), bool)
                edge[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
                at = np.flatnonzero(edge)
                size_of = (start[np.append(at[1:], len(doc)) - 1] - start[at] + 1).astype(np.int32)
                for i in range(0, len(at), 100_000):
                    s = slice(i, i + 100_000)
                    d, t = doc[at[s]], start[at[s]]
                    k = mix(d.view(np.uint64) ^ mix(t.astype(np.uint64), 5), 6)
                    yield _repeat_batch(k, (mix(k, 7) >> np.uint64(32)).astype(np.uint32), d, t, size_of[s], True)

        total = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, w in chunks(batch.column(1)):
                h = w.hashes()
                at, g, _ = window_minima(w, h, size)
                hit = plan.mine(g)
                for r, c in enumerate(plan.cells(g)):
                    hit &= (bits[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
                at = at[hit]
                if not len(at):
                    continue
                d = w.doc[at]
                held.append([spans_hash(h, at, at + size), (spans_hash(w.hashes(SECOND), at, at + size) >> np.uint64(32)).astype(np.uint32), ids[i:j][d], (at - w.first[d]).astype(np.int32)])
                total += len(at)
            if total > HELD:
                yield from flush()
                total = 0
        yield from flush()

    return run


def _repeat_batch(a, b, doc, start, size, sure) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(as_long(a)), pa.array(b.view(np.int32)), pa.array(doc), pa.array(start), pa.array(size), pa.array(np.full(len(a), sure))], names=["a", "b", "doc_id", "start", "len", "sure"])


def _packed(batches):
    """doc_id and the text compressed: half of what the shuffle's own codec makes of it."""
    for batch in batches:
        texts = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])


def _removed(size: int):
    """Streams rows sorted by document: its removals, then its text."""

    def run(batches):
        at, cuts = None, []
        for batch in batches:
            ids, kinds, starts, lens = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            texts = batch.column(4)
            out = []
            text_rows = np.flatnonzero(kinds == 1)
            lo = 0
            for t in [*text_rows.tolist(), len(ids)]:
                if t > lo:
                    # removals of one or of several documents; only those of the last may still wait for a text
                    same = ids[lo:t] == ids[t - 1]
                    if at != ids[t - 1]:
                        cuts = []
                    at = ids[t - 1]
                    cuts.append((starts[lo:t][same], lens[lo:t][same]))
                if t < len(ids):
                    text = texts[t].as_py()
                    out.append((ids[t], *_kept(b"" if text is None else zlib.decompress(text), cuts if at == ids[t] else [], size)))
                lo = t + 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _kept(text: bytes, cuts: list, size: int) -> tuple[int, int, str, str]:
    words = text.split()
    if not cuts:
        kept = b" ".join(words)
        return len(words), 0, hashlib.sha256(kept).hexdigest(), kept.decode()
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n in cuts:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n + size - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = b" ".join(compress(words, keep.tolist()))
    return len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of docs (doc_id long, text string).

    A word goes if a window of size words that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document. Rows that repeat a doc_id count as one document and are cut alike; rows with a null doc_id count as
    the last document. Null texts have no words; texts of fewer than size words lose none. Extra columns are ignored;
    an empty table gives no rows. kept_text joins the kept words by one space."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    turns = plans(docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0)
    found = None
    for plan in turns:
        sketch = spark.sparkContext.broadcast(repeated_cells(docs.select("text"), size, plan))
        some = docs.mapInArrow(_candidates(size, sketch, plan), REPEATS)
        if len(turns) > 1:
            # passes in turn: one sketch lies in memory at a time
            some = cut(some, "windows")
            sketch.unpersist()
        found = some if found is None else found.unionByName(some)
    place = F.rank().over(Window.partitionBy("a", "b").orderBy("doc_id", "start"))
    gone = found.withColumn("place", place).filter(F.col("sure") | (F.col("place") > 1))
    rows = gone.select("doc_id", F.lit(0).alias("kind"), "start", "len", F.lit(None).cast("binary").alias("text"))
    rows = rows.unionByName(docs.mapInArrow(_packed, "doc_id long, text binary").select("doc_id", F.lit(1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("len"), "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(n, "doc_id").sortWithinPartitions("doc_id", "kind", "start").mapInArrow(_removed(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST, F.col("doc_id")))

