"""Benchmark decontamination by greedy string tiling (operator 4).

Words are lower-cased and freed of ASCII punctuation. Runs of TILE words (seeds) of the benchmark items are joined with
those of the documents; an upper bound of coverage from the seeds alone rejects most pairs. For the others, the longest
matches between item and document that no tile covers yet are marked again and again, found by running Karp-Rabin
hashes, down to tiles of TILE words. Tiles may stand in any order, so reordered passages count.

The benchmark is a query set of its own: it is broadcast in blocks of about BLOCK_WORDS words, however large it is, one
after the other, and each block is held against all documents. Nothing is shuffled; if there are several blocks, the
documents with the verdict so far are written between them."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, tune
from tessera.llm.words import Words, chunks, spans_hash, split

TILE, COVERAGE = 4, 0.6
#: The size bound of a broadcast: words of the benchmark items in one block, about.
BLOCK_WORDS = 1_000_000
#: Rows of matches that are looked at together.
HITS = 4_000_000

#: A-Z lower-cased, ASCII punctuation and control characters as blanks.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[65:91] += 32
NORMAL[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def normal_words(arr: pa.Array):
    """(from, to, words, hashes) over the rows of a text column, words by NORMAL."""
    for i, j, w in chunks(arr):
        # the chunk anew, with punctuation blanked; document bounds stay
        off = np.concatenate([[0], np.cumsum(w.sizes)])
        x = split(NORMAL[w.buf], off)
        yield i, j, x, x.hashes()


class Index(NamedTuple):
    """Seeds of one benchmark block, sorted: by length of seed, since an item shorter than TILE is one seed."""

    items: np.ndarray  # item ids
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length: hashes, first row of each, items, positions


def build(ids: list[int], texts: list[str | None], tile: int) -> Index:
    words: list[np.ndarray] = []
    for _, _, w, h in normal_words(pa.array([t or "" for t in texts], pa.string())):
        words += [h[w.first[d] : w.first[d + 1]] for d in range(w.docs)]
    rows: dict[int, list] = {}
    for i, h in enumerate(words):
        k = min(tile, len(h))
        if k:
            at = np.arange(len(h) - k + 1)
            rows.setdefault(k, []).append((spans_hash(h, at, at + k), np.full(len(at), i), at))
    seeds = {}
    for k, parts in rows.items():
        g, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g, kind="stable")
        g, item, pos = g[order], item[order], pos[order]
        u, first = np.unique(g, return_index=True)
        seeds[k] = (u, np.append(first, len(g)), item, pos)
    return Index(np.array(ids, np.int64), words, seeds)


def _matches(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(-length, item position, text position) of all maximal matches of at least `least` words, by rolling hashes of
    runs of that length: runs that match one after the other on a diagonal are one match. Matching runs are looked at
    HITS at a time; what a piece of the item leaves open at its end goes on in the next."""
    if len(item) < least or len(text) < least:
        return []
    t = np.arange(len(text) - least + 1)
    broken = np.concatenate([[0], np.cumsum(text == 0)])
    t = t[broken[least:] == broken[: len(t)]]
    th = spans_hash(text, t, t + least)
    order = np.argsort(th, kind="stable")
    t, th = t[order], th[order]
    ph = spans_hash(item, np.arange(len(item) - least + 1), np.arange(least, len(item) + 1))
    lo, hi = np.searchsorted(th, ph, "left"), np.searchsorted(th, ph, "right")
    n = hi - lo
    ends = np.cumsum(n)
    out: list[tuple[int, int, int]] = []
    open_diag, open_from = np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
        p = np.repeat(np.arange(i, j), n[i:j])
        at = np.repeat(lo[i:j], n[i:j]) + np.arange(len(p)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        # on each diagonal, in order of the item; what is open counts as a run just before
        diag = np.concatenate([open_diag, t[at] - p])
        pos = np.concatenate([np.full(len(open_diag), i - 1), p])
        since = np.concatenate([open_from, p])
        order = np.lexsort((pos, diag))
        diag, pos, since = diag[order], pos[order], since[order]
        first = np.flatnonzero(np.diff(diag, prepend=-(1 << 62)).astype(bool) | (np.diff(pos, prepend=-9) != 1))
        last = np.append(first[1:], len(diag)) - 1
        still = pos[last] == j - 1 if len(first) else np.zeros(0, bool)
        still &= j < len(n)
        open_diag, open_from = diag[first[still]], since[first[still]]
        s, e, d = since[first[~still]], pos[last[~still]], diag[first[~still]]
        out += zip((s - e - least).tolist(), s.tolist(), (s + d).tolist(), strict=True)
        i = j
    return out


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item position, text position, length) of greedy string tiling; hashes of words; 0 in text never matches.

    The longest match of words that no tile covers yet is marked, of equal ones that of the smallest item position, then
    text position, as long as one of `least` words is left. What an earlier tile cuts off is a match of its own."""
    p_mark, t_mark = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    heap, left = _matches(item, text, least), len(item)
    heapq.heapify(heap)
    while heap and left >= least:
        n, p, t = heapq.heappop(heap)
        taken = p_mark[p : p - n] | t_mark[t : t - n]
        if not taken.any():
            p_mark[p : p - n] = t_mark[t : t - n] = True
            out.append((p, t, -n))
            left += n
            continue
        edges = np.flatnonzero(np.diff(taken, prepend=True, append=True)).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
            heapq.heappush(heap, (a - b, p + a, t + a))
    return out


def covered(w: Words, h: np.ndarray, index: Index, tile: int, coverage: float):
    """(document, item, coverage, tiles) of pairs that share enough, of one chunk of documents."""
    for k, (u, first, items, pos) in index.seeds.items():
        at, g = w.grams(h, k)
        if not len(g) or not len(u):
            continue
        near = np.minimum(np.searchsorted(u, g), len(u) - 1)
        hit = np.flatnonzero(u[near] == g)
        at, near = at[hit], near[hit]
        # each seed of a document once, so that a document makes no more rows than the block has seeds
        doc, seed = np.divmod(np.unique(w.doc[at] * len(u) + near), len(u))
        n = (first[seed + 1] - first[seed]).astype(np.int64)
        bounds = np.searchsorted(doc, np.arange(w.docs + 1))
        ends = np.concatenate([[0], np.cumsum(n)])[bounds]
        d = 0
        while d < w.docs:
            # documents whose seeds make HITS rows, or one document
            e = max(d + 1, int(np.searchsorted(ends, ends[d] + HITS, "right")) - 1)
            s = slice(bounds[d], bounds[e])
            row = np.repeat(first[seed[s]], n[s]) + np.arange(n[s].sum()) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
            yield from _tiled(w, h, index, np.repeat(doc[s], n[s]), items[row], pos[row], at, g[hit], k, tile, coverage)
            d = e


def _tiled(w: Words, h: np.ndarray, index: Index, doc, item, pos, at, g, k: int, tile: int, coverage: float):
    """Tiles the pairs of document and item whose seeds (doc, item, pos) may cover enough; at, g: places of seeds of k words."""
    if not len(doc):
        return
    order = np.lexsort((pos, item, doc))
    doc, item, pos = doc[order], item[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    gap = np.full(len(doc), k)
    gap[:-1] = np.where(new[1:], k, np.minimum(k, pos[1:] - pos[:-1]))
    start = np.flatnonzero(new)
    words = np.array([len(x) for x in index.words])
    for s in start[np.add.reduceat(gap, start) >= coverage * words[item[start]]]:
        of = index.words[item[s]]
        here = slice(*np.searchsorted(w.doc[at], [doc[s], doc[s] + 1]))
        own = spans_hash(of, np.arange(len(of) - k + 1), np.arange(k, len(of) + 1))
        # the document's words that a seed of the item touches, with a break where they don't adjoin
        touched = np.unique((at[here][np.isin(g[here], own)][:, None] + np.arange(k)).ravel())
        text = np.insert(h[touched], np.flatnonzero(np.diff(touched) > 1) + 1, 0)
        found = tiles(of, text, min(tile, len(of)))
        share = sum(x[2] for x in found) / len(of)
        if share >= coverage:
            yield int(doc[s]), int(index.items[item[s]]), share, len(found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, contaminated, item_id, coverage, tiles, leaks for each row of docs (doc_id, text), with the columns of keep
    (none named as a result).

    An item (item_id, text) leaks into a document if tiles cover at least `coverage` of its words; item_id, coverage and
    tiles are of the item covered most (the smallest id of equal ones), leaks counts such items. Items without words,
    null texts and null ids of items are never found; texts of fewer than `tile` words only match items as short. Null
    columns of clean documents: item_id; coverage and tiles are 0. Rows that repeat a doc_id are judged apart."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (5 * BLOCK_WORDS)))
    kept = [c for c in keep if c not in ("doc_id", "text")]
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), *kept)
    base = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    for b in range(blocks):
        before = found
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(build([r.item_id for r in block], [r.text for r in block], tile))
        found = found.mapInArrow(_judge(index, tile, coverage, b > 0), f"{base}, item_id long, coverage double, tiles int, leaks int")
        if b + 1 < blocks:
            # blocks in turn: one lies in memory at a time
            found = cut(found, "judged")
            index.unpersist()
            forget(before)
    return found.select("doc_id", *(["text"] if "text" in keep else []), *kept, (F.col("leaks") > 0).alias("contaminated"), "item_id", "coverage", "tiles", "leaks")


def _judge(index, tile: int, coverage: float, again: bool):
    """Adds the verdict of one block to that of the blocks before, which then are the last four columns."""
    verdict = ["item_id", "coverage", "tiles", "leaks"]

    def run(batches):
        for batch in batches:
            own = batch.num_columns - 4 * again
            if again:
                old = [batch.column(own + i).to_pylist() for i in range(4)]
                best = list(zip(old[1], old[0], old[2], old[3], strict=True))
            else:
                best = [(0.0, None, 0, 0)] * batch.num_rows
            for i, _, w, h in normal_words(batch.column(1)):
                for d, item, share, count in covered(w, h, index.value, tile, coverage):
                    now = best[i + d]
                    win = share > now[0] or share == now[0] and (now[1] is None or item < now[1])
                    best[i + d] = (*((share, item, count) if win else now[:3]), now[3] + 1)
            share, item, count, leaks = zip(*best, strict=True) if best else ([],) * 4
            new = [pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(count, pa.int32()), pa.array(leaks, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *new], names=[*batch.schema.names[:own], *verdict])

    return run
