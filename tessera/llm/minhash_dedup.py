"""Near-duplicate documents by b-bit MinHash (operator 6).

Every distinct set of word shingles gets PERMS minima. Band keys (ROWS minima each) bring sets together; the low
BITS bits of all minima, packed into 64-bit words, estimate similarity from counts of equal fields, corrected for
the 2**-BITS chance of a collision. Estimates only choose what is confirmed, on full sets.

A pair of similarity 0.8 misses all bands with probability (1 - 0.8**4)**32 < 1e-7, and falls below the margin of
the estimate with probability < 1e-6. Only connections count. So first every set is confirmed against one partner, the
smallest id that is surely alike or else the best by estimate, which gives a forest. Then buckets that hold several
components are held against themselves: sets that may link across components by estimate, by size and by the shingles
that other components hold at all, meet again with those shingles, and their exact intersections decide. A task emits
a forest of what it links, never pairs. Buckets are counted first; a large one is cut into tiles of a bounded size."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, only, salted_join, tune
from tessera.llm.components import labels, roots
from tessera.llm.words import LOWER, as_long, chunks, column_bytes, mix

ROWS, BANDS, BITS = 4, 32, 2
PERMS = ROWS * BANDS
FIELDS = np.uint64(0x5555555555555555)
#: Five standard deviations of the estimate at similarity 0.8: sqrt(.85 * .15 / 128) / .75 = 0.042.
MARGIN = 0.21
#: Rows of a bucket in one block, about.
BLOCK = 512
#: An estimate that is hardly ever seen under 0.8.
SURE = 0.9
#: Tasks that hold the partners of one set, at most.
SALTS = 32
PAIRS, OPEN = "a long, b long, est double", "tile long, head long, comp long, side long, sig binary"

_rng = np.random.default_rng(20240229)
MULT = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def shingle_sets(arr: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) for each row of a text column; a shorter text is one shingle."""
    for i, j, w in chunks(arr):
        h = w.hashes(LOWER)
        at, g = w.grams(h, k)
        doc = w.doc[at]
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < k))
        cut_at = np.searchsorted(doc, np.arange(j - i + 1))
        alone = {}
        for d in short:
            x = h[w.first[d] : w.first[d + 1]]
            acc = np.uint64(len(x))
            for v in x:
                acc = mix(np.array([acc ^ v]))[0]
            alone[int(d)] = np.array([acc], np.uint64)
        for d in range(j - i):
            yield i + d, alone[d] if d in alone else np.unique(g[cut_at[d] : cut_at[d + 1]])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PERMS minima per non-empty set: min of the high 32 bits of multiply-add hashes."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), PERMS), np.uint32)
    for p in range(PERMS):
        out[:, p] = np.minimum.reduceat(((flat * MULT[p] + PLUS[p]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum, 64 // BITS to a word: (rows, minima * BITS // 64)."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(m), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ m[:, r::ROWS].astype(np.uint64), r)
    return mix(keys ^ np.arange(BANDS, dtype=np.uint64), 99)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: the share of equal fields, less what chance makes equal."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & FIELDS).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / (a.shape[-1] * 64 // BITS) - chance) / (1 - chance)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits of the whole set), sig, keys; sig and keys are empty for an empty set."""

    def run(batches):
        for batch in batches:
            n, sa, sb, sig, keys = [], [], [], [], []
            held: list[np.ndarray] = []

            def flush():
                if held:
                    m = minima(held)
                    sig.extend(x.tobytes() for x in packed(m))
                    keys.extend(as_long(band_keys(m)).tolist())
                    held.clear()

            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                sa.append(int(as_long(mix(s, 1).sum(dtype=np.uint64, keepdims=True))[0]) if len(s) else 0)
                sb.append(int(as_long(mix(s, 2).sum(dtype=np.uint64, keepdims=True))[0]) if len(s) else 0)
                if len(s):
                    held.append(s)
                    if sum(map(len, held[-64:])) > 200_000 or len(held) >= 256:
                        flush()
                else:
                    flush()
                    sig.append(b"")
                    keys.append([])
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>")


class Run(NamedTuple):
    """Members of one tile: columns of arrays. side: -1 where all are compared, else only members of different sides."""

    tile: np.ndarray
    ids: np.ndarray
    comp: np.ndarray
    size: np.ndarray
    side: np.ndarray
    sig: np.ndarray
    common: list  # of exact tiles: the sorted shingles that other components hold as well


def _runs(batches):
    """Streams rows sorted by tile, of a bounded size each, as runs of two members or more."""
    rest: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
        now.append(column_bytes(batch.column(5))[0].view(np.uint64).reshape(batch.num_rows, -1))
        now.append(np.arange(batch.num_rows))
        sets = [np.sort(x.values.to_numpy()) for x in batch.column(6)] if batch.num_columns > 6 else None
        bounds = [0, *(np.flatnonzero(np.diff(now[0])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = [x[lo:hi] for x in now[:6]] + [sets[lo:hi] if sets else []]
            if rest and rest[-1][0][0] != part[0][0]:
                yield from _run(rest)
                rest = []
            rest.append(part)
    yield from _run(rest)


def _run(parts: list[list]):
    if sum(len(p[0]) for p in parts) > 1:
        yield Run(*(np.concatenate(x) for x in list(zip(*parts, strict=True))[:6]), [s for p in parts for s in p[6]])


def may_link(na, nb, common, percent: int):
    """False where sets of na and nb members with at most `common` in common cannot reach the similarity."""
    common = np.minimum(common, np.minimum(na, nb))
    return 100 * common >= percent * (na + nb - common)


def _best(least: float, percent: int):
    """For each set a partner of a smaller id within its tile: the smallest that is surely alike, or else the one of the
    highest estimate, if that is at least least."""

    def run(batches):
        a, b, e = [], [], []
        for r in _runs(batches):
            order = np.argsort(r.ids, kind="stable")
            x, n, s = r.ids[order], r.size[order], r.sig[order]
            for lo in range(1, len(x), 128):
                hi = min(len(x), lo + 128)
                est = estimate(s[lo:hi, None, :], s[None, :hi, :])
                est[x[None, :hi] >= x[lo:hi, None]] = -1
                est[~may_link(n[lo:hi, None], n[None, :hi], n[None, :hi], percent)] = -1
                sure = est >= SURE
                p = np.where(sure.any(1), sure.argmax(1), est.argmax(1))
                v = est[np.arange(hi - lo), p]
                ok = v >= least
                a.append(x[lo:hi][ok])
                b.append(x[p[ok]])
                e.append(v[ok])
            if sum(map(len, a)) > 20_000:
                yield _batch(PAIRS, a, b, e)
                a, b, e = [], [], []
        yield _batch(PAIRS, a, b, e)

    return run


def _batch(schema: str, *cols: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [np.float64 if k == "double" else np.int64 for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(cols, types, strict=True)], names=list(names))


def _pairs_of(r: Run, least: float, percent: int, common: np.ndarray):
    """(rows lo to hi, whether each may link with each member of the tile): different components, of different sides if
    the tile has sides, by sizes, by shingles in common at most and by estimate."""
    for lo in range(0, len(r.ids), 128):
        q = slice(lo, lo + 128)
        ok = (r.comp[q, None] != r.comp[None, :]) & ((r.side[q, None] != r.side[None, :]) | (r.side[q, None] < 0))
        if ok.any():
            ok &= may_link(r.size[q, None], r.size[None, :], np.minimum(common[q, None], common[None, :]), percent)
        if ok.any():
            ok &= estimate(r.sig[q, None, :], r.sig[None, :, :]) >= least
        yield lo, ok


def _open(least: float, percent: int):
    """The members of a tile that may link with one of another component, by estimate and sizes, under a new name of
    the tile: equal members, equal name, as sets that are alike share many buckets."""
    names = [c.split()[0] for c in OPEN.split(", ")]

    def run(batches):
        for r in _runs(batches):
            if r.comp.min() < r.comp.max():
                hit = np.flatnonzero(np.concatenate([ok.any(1) for _, ok in _pairs_of(r, least, percent, r.size)]))
                each = mix(r.ids[hit].view(np.uint64) ^ mix(r.side[hit].view(np.uint64), 3), 4)
                tile = as_long(np.full(len(hit), each.sum(dtype=np.uint64)))
                cols = [pa.array(x) for x in (tile, r.ids[hit], r.comp[hit], r.side[hit])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in r.sig[hit]], pa.binary())], names=names)

    return run


def _shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many members each two sets have in common: products of their incidence matrix, some columns at a time."""
    u, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    held = np.flatnonzero(np.bincount(at) > 1)
    name = np.full(len(u), -1)
    name[held] = np.arange(len(held))
    at = name[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, len(held), columns):
        s = slice(*np.searchsorted(at, [lo, lo + columns]))
        x = np.zeros((len(sets), min(columns, len(held) - lo)), np.float32)
        x[row[s], at[s] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _exact(least: float, percent: int):
    """Links between components that a tile's full sets confirm, as a forest: fewer rows than the tile has members."""

    def run(batches):
        a, b = [], []
        for r in _runs(batches):
            if r.comp.min() == r.comp.max():
                continue
            common = np.array([len(s) for s in r.common])
            ok = np.concatenate([x for _, x in _pairs_of(r, least, percent, common)])
            at = np.flatnonzero(ok.any(1))
            if not len(at):
                continue
            n = _shared([r.common[i] for i in at])
            link = ok[np.ix_(at, at)] & (100 * n >= percent * (r.size[at][:, None] + r.size[at][None, :] - n)) & (n > 0)
            comp = r.comp[at]
            link |= comp[:, None] == comp[None, :]
            low = comp.copy()
            while True:
                new = np.where(link, low[None, :], low[:, None]).min(1)
                if (new == low).all():
                    break
                low = new
            pairs = np.unique(np.stack([comp, low])[:, comp != low], axis=1)
            a.append(pairs[0])
            b.append(pairs[1])
        yield _batch("a long, b long", a, b)

    return run


def _tiles(rows: DataFrame) -> DataFrame:
    """Adds tile and side to rows (key, head, comp and more), of buckets that hold different components only.

    A bucket of at most BLOCK rows is one tile. A larger one is cut into blocks by hash: members of its most frequent
    component need no comparison with each other, so blocks of them meet blocks of the others, and those meet among
    themselves. A tile holds two blocks, about, whatever the bucket's size."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    open_keys = per.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("comps > 1").drop("comps")
    df = rows.join(open_keys, "key")
    hashed = F.xxhash64("head", "key")
    m, s = F.ceil(F.col("most") / BLOCK), F.ceil((F.col("n") - F.col("most")) / BLOCK)
    of_main, of_rest = F.pmod(hashed, m), F.pmod(hashed, s)
    name = lambda *c: F.xxhash64("key", *c)
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda tile, side: F.struct(tile.alias("tile"), side.cast("long").alias("side"))
    whole = F.array(place(name(F.lit(0)), F.lit(-1)))
    main = F.transform(to(s), lambda j: place(name(F.lit(1), of_main, j), F.lit(0)))
    rest = F.transform(to(m), lambda i: place(name(F.lit(1), i, of_rest), F.lit(1)))
    inner = F.transform(to(s), lambda j: place(name(F.lit(2), F.least(of_rest, j), F.greatest(of_rest, j)), F.when(of_rest == j, F.lit(-1)).otherwise((of_rest > j).cast("int"))))
    places = F.when(F.col("n") <= BLOCK, whole).when(F.col("comp") == F.col("main"), main).otherwise(F.concat(rest, inner))
    return df.withColumn("at", F.explode(places)).select("at.tile", "head", "comp", "size", "at.side", *(c for c in rows.columns if c not in ("key", "head", "comp", "size")))


def _by_tile(rows: DataFrame) -> DataFrame:
    # a fixed number of partitions, as time goes into comparisons, which the rows' bytes don't tell
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tile").sortWithinPartitions("tile")


def _texts(docs: DataFrame, k: int) -> DataFrame:
    """head, comp, which, size, shingle: the sets of texts (head, comp, text); which tells texts of one id apart."""

    def rows(ids, comp, found):
        at = np.repeat([i for i, _ in found], [len(s) for _, s in found])
        which = np.repeat(np.array([as_long(mix(s, 1).sum(dtype=np.uint64, keepdims=True))[0] for _, s in found], np.int64), [len(s) for _, s in found])
        size = np.repeat([len(s) for _, s in found], [len(s) for _, s in found])
        flat = as_long(np.concatenate([s for _, s in found]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], comp[at], which, size, flat)], names=["head", "comp", "which", "size", "shingle"])

    def run(batches):
        for batch in batches:
            ids, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            found, total = [], 0
            for i, s in shingle_sets(batch.column(2), k):
                if len(s):
                    found.append((i, s))
                    total += len(s)
                if total > 100_000:
                    yield rows(ids, comp, found)
                    found, total = [], 0
            if found:
                yield rows(ids, comp, found)

    return docs.select("head", "comp", "text").mapInArrow(run, "head long, comp long, which long, size long, shingle long")


def _confirm(parents: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (a, b) of parents, one an a, whose full sets have 100 * intersection >= percent * union. A b of many a is dealt
    over SALTS tasks, so its text is read that often at most."""
    parents = parents.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    need = parents.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).cast("long").alias("role"))
    need = need.unionByName(parents.groupBy("b", "salt").agg(F.lit(0).cast("long").alias("role")).withColumn("doc_id", F.col("b")))
    rows = only(docs.select("doc_id", "text"), need.select("doc_id")).join(need, "doc_id").select("b", "salt", "role", "doc_id", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches):
        at, first = None, []
        for batch in batches:
            b, salt, role, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keep_a, keep_b = [], []
            for i, s in shingle_sets(batch.column(4), k):
                if at != (b[i], salt[i]):
                    at, first = (b[i], salt[i]), []
                if role[i] == 0:
                    first.append(s)
                    continue
                n = [len(np.intersect1d(s, f, assume_unique=True)) for f in first]
                if any(100 * c >= percent * (len(s) + len(f) - c) and c for c, f in zip(n, first, strict=True)):
                    keep_a.append(ids[i])
                    keep_b.append(b[i])
            yield _batch("a long, b long", [keep_a], [keep_b])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text string).

    Words are runs of bytes other than white space, A-Z lower-cased; a set holds the distinct runs of k words, or
    the whole sequence if it is shorter. Null or wordless texts have an empty set and stand alone. Equal sets share a
    component. Rows with a null doc_id are kept out of links; their component is that of an equal set, or null. Rows that
    repeat a doc_id are one document: what one of its texts links with, all of them do, but an empty text. Extra columns
    are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of_set = ["set_a", "set_b", "n_shingles"]
    sets = cut(signatures(docs, k), "sets")
    full = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = cut(full.groupBy(*of_set).agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "heads")
    least = percent / 100 - MARGIN

    # buckets of two sets or more, counted before any is brought together; those that hold more than a block are cut
    rows = heads.select(F.explode("keys").alias("key"), "head")
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("head").alias("low")).filter("n > 1"), "key")
    buckets = cut(shared.join(heads.select("head", F.col("n_shingles").alias("size"), "sig"), "head").select("key", "head", "size", "sig", "n", "low"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK)
    # the smallest id of a bucket stands in all of its blocks
    block = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).when(F.col("head") == F.col("low"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("head", "key"), blocks)))
    dealt = buckets.withColumn("block", F.explode(block)).select(F.xxhash64("key", "block").alias("tile"), "head", F.col("head").alias("comp"), "size", F.lit(-1).cast("long").alias("side"), "sig")
    best = _by_tile(dealt).mapInArrow(_best(least, percent), PAIRS).groupBy("a").agg(F.coalesce(F.min(F.when(F.col("est") >= SURE, F.col("b"))), F.max_by("b", "est")).alias("b"))
    best = cut(best, "best")
    first = cut(roots(_confirm(best, docs, k, percent).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))), "labels")
    forget(best)

    # what may still link: sets of different components that share a bucket and are alike by estimate ...
    named = F.coalesce("comp", "head").alias("comp")
    known = buckets.drop("n", "low").join(first.withColumnRenamed("node", "head"), "head", "left").select("key", "head", named, "size", "sig")
    known = cut(known, "known")
    forget(buckets)
    met = cut(_by_tile(_tiles(known)).mapInArrow(_open(least, percent), OPEN).distinct(), "met")
    forget(known)
    left = cut(met.select(F.col("head").alias("doc_id"), "comp").distinct(), "open")
    # ... and of whose shingles the others hold enough: a link between components can only consist of these
    texts = only(docs, left).join(left, "doc_id").select(F.col("doc_id").alias("head"), "comp", "text")
    flat = cut(_texts(texts, k), "shingles")
    others = flat.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
    common = flat.join(others, "shingle", "left_semi").groupBy("head", "which", "size").agg(F.collect_list("shingle").alias("common"))
    rest = cut(common.filter(100 * F.size("common") >= percent * F.col("size")).select("head", "size", "common"), "rest")
    forget(left, flat)
    links = _by_tile(met.join(rest, "head").select("tile", "head", "comp", "size", "side", "sig", "common")).mapInArrow(_exact(least, percent), "a long, b long")
    links = cut(links.unionByName(_repeated(sets, heads, first, of_set)), "links")
    forget(met, rest)

    second = labels(links)
    forget(links)
    final = salted_join(first, second.select(F.col("node").alias("comp"), F.col("comp").alias("top")), ["comp"]).select("node", F.coalesce("top", "comp").alias("comp"))
    final = final.unionByName(second)
    names = heads.select(*of_set, "head", "copies").join(final.withColumnRenamed("node", "head"), "head", "left").withColumn("component_id", F.coalesce("comp", "head"))
    # a set that stands alone is its own component; only the others carry news
    news = names.filter((F.col("copies") > 1) | (F.col("component_id") != F.col("head"))).select(*of_set, "component_id").groupBy(*of_set).agg(F.min("component_id").alias("component_id"))
    out = salted_join(sets.select("doc_id", *of_set), news, of_set, salts=16)
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated(sets: DataFrame, heads: DataFrame, first: DataFrame, of_set: list[str]) -> DataFrame:
    """Links (a, b) between the components of the sets of one doc_id that several rows have."""
    full = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    several = full.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = full.select("doc_id", *of_set).join(several, "doc_id", "left_semi").join(heads.select(*of_set, "head"), of_set)
    rows = rows.join(first.withColumnRenamed("node", "head"), "head", "left").select("doc_id", F.coalesce("comp", "head").alias("comp"))
    low = rows.groupBy("doc_id").agg(F.min("comp").alias("b"))
    return rows.join(low, "doc_id").select(F.col("comp").alias("a"), "b").filter("a <> b").distinct()
