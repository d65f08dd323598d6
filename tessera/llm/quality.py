"""Quality by nearest-neighbour voting in a latent-semantic space (operator 1).

Terms say how a text is written and of what: shapes of words (letter case, digits, marks, runs collapsed), words that
repeat ones just before, words without regard to case, and pairs of shapes and of words; hashed into buckets. Inverse document frequencies count all documents. A
bounded sample of labelled rows (PER_CLASS of each label) fixes a truncated singular value decomposition and, projected
and normalised, the labelled vectors. These are broadcast (PER_CLASS x 2 x RANK floats); every document takes exact
cosine products with all of them, in blocks, and its nearest vote with weights by similarity."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, id_crc, tune
from tessera.llm.words import LOWER, SPACE, chunks, mix, spans_hash

#: Buckets of shapes, of words, of both; the rank of the space; neighbours that vote.
SHAPES, WORDS = 2048, 2048
TERMS, RANK, NEIGHBOURS = SHAPES + WORDS, 48, 15
#: What a word weighs beside a shape.
WORD_WEIGHT = 0.5
#: The bound of the fit: about so many labelled rows of each label value.
PER_CLASS = 2000
#: A neighbour's weight is its similarity to this power.
SHARPNESS = 8

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58], SHAPE[SPACE] = 65, 97, 97, 48, 0


def sparse(cells: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, counts) of occurrences numbered row * terms + term, in that order."""
    at, n = np.unique(cells, return_counts=True)
    return at // terms, at % terms, n.astype(np.float32)


def term_counts(arr: pa.Array):
    """(from, to, rows, terms, counts) over the rows of a text column: the terms that each row holds."""
    for i, j, w in chunks(arr):
        h = w.hashes()
        shape = SHAPE[w.buf]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[w.start] = True
        at = np.cumsum(keep) - 1
        s = spans_hash(shape[keep], at[w.start], at[w.end - 1] + 1) if len(w.start) else np.zeros(0, np.uint64)
        named = spans_hash(LOWER[w.buf], w.start, w.end)
        found = [(s, w.doc, 0, SHAPES), (named, w.doc, SHAPES, WORDS)]
        if len(h) > 1:
            same = w.doc[1:] == w.doc[:-1]
            for x, first, size in ((s, 0, SHAPES), (named, SHAPES, WORDS)):
                found.append((mix(x[:-1] ^ mix(x[1:], 1), 2)[same], w.doc[1:][same], first, size))
        for back in (1, 2, 3):
            again = np.flatnonzero((h[back:] == h[:-back]) & (w.doc[back:] == w.doc[:-back])) + back
            found.append((np.full(len(again), mix(np.array([back], np.uint64), 3)[0]), w.doc[again], 0, SHAPES))
        cell = [doc * TERMS + first + (x & np.uint64(size - 1)).astype(np.int64) for x, doc, first, size in found]
        yield i, j, *sparse(np.concatenate(cell), TERMS)


def document_frequencies(texts: DataFrame, counter, terms: int) -> tuple[np.ndarray, int]:
    """(documents that hold each term, documents): summed per task first, then over tasks; terms + 1 rows reach the driver."""

    def run(batches):
        total, docs = np.zeros(terms, np.int64), 0
        for batch in batches:
            for i, j, _, term, _ in counter(batch.column(0)):
                total += np.bincount(term, minlength=terms)
                docs += j - i
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, terms)), pa.array(np.append(total[at], docs))], names=["term", "n"])

    df = np.zeros(terms + 1, np.int64)
    for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return df[:-1], int(df[-1])


def sample_counts(rows: DataFrame, counter, terms: int) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """(labels, (terms, counts) of each) of a bounded sample (doc_id, label, text), in doc_id order; sent as 16-bit pairs."""
    kind = dict(rows.dtypes)["label"]

    def run(batches):
        for batch in batches:
            packed = []
            for i, j, row, term, n in counter(batch.column(2)):
                bound = np.searchsorted(row, np.arange(j - i + 1))
                term, n = term.astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)
                packed += [term[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(bound, bound[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "label", "counts"])

    got = sorted(rows.select("doc_id", "label", "text").mapInArrow(run, f"doc_id long, label {kind}, counts binary").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.counts)))
    pairs = []
    for r in got:
        both = np.frombuffer(bytes(r.counts), np.uint16)
        pairs.append((both[: len(both) // 2], both[len(both) // 2 :]))
    return [r.label for r in got], pairs


def products(docs: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums of value * matrix[term] by row, for rows in order; a piece at a time, so that memory stays small."""
    out = np.zeros((docs, matrix.shape[1]), np.float32)
    for lo in range(0, len(row), 100_000):
        s = slice(lo, lo + 100_000)
        start = np.flatnonzero(np.diff(row[s], prepend=-1))
        if len(start):
            out[row[s][start]] += np.add.reduceat(value[s, None] * matrix[term[s]], start)
    return out


class Model(NamedTuple):
    weight: np.ndarray  # of terms
    basis: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # of labelled rows, normalised
    labels: np.ndarray
    votes: np.ndarray  # of a labelled row: rows of its class for each one sampled
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def weighted(docs: int, row: np.ndarray, term: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of shares, by term weight; rows of length one."""
    v = np.sqrt(n) * weight[term]
    return v / np.maximum(np.sqrt(np.bincount(row, v * v, docs)), 1e-12)[row].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from labels (doc_id, label) of docs (doc_id, text); rows with a null label or id are left out. Of labels
    that contradict each other for one doc_id the smallest holds."""
    tune(docs.sparkSession)
    df, n = document_frequencies(docs.select(F.col("text").cast("string")), term_counts, TERMS)
    weight = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    weight[SHAPES:] *= WORD_WEIGHT
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    whole = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    some = F.broadcast(bounded_sample(known, "label", per_class, seed=7))
    y, pairs = sample_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id"), term_counts, TERMS)
    y = np.array(y, np.float32)
    if not len(y):
        return Model(weight, np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), y, y, 0.5)
    x = np.zeros((len(y), TERMS), np.float32)
    for row, (at, n_of) in zip(x, pairs, strict=True):
        row[at] = weighted(1, np.zeros(len(at), np.int64), at.astype(np.int64), n_of.astype(np.float32), weight)
    basis = decompose(x, RANK)
    votes = np.array([whole[int(k)] / (y == k).sum() for k in y], np.float32)
    return Model(weight, basis, _unit(x @ basis), y, votes, float((votes * y).sum() / votes.sum()))


def decompose(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration."""
    rng = np.random.default_rng(5)
    q = rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank])


def vote(docs: int, row: np.ndarray, term: np.ndarray, n: np.ndarray, m: Model) -> np.ndarray:
    """Scores of rows of term counts: cosine products with all labelled vectors in blocks, then the weighted vote."""
    z = _unit(products(docs, row, term, weighted(docs, row, term, n, m.weight), m.basis))
    out = np.full(len(z), m.prior)
    if not len(m.labels):
        return out
    k = min(NEIGHBOURS, len(m.labels))
    for i in range(0, len(z), 256):
        cos = z[i : i + 256] @ m.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS * m.votes[near]
        total = w.sum(1)
        out[i : i + 256] = np.where(total > 1e-9, (w * m.labels[near]).sum(1) / np.maximum(total, 1e-9), m.prior)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs (doc_id, text), with the columns of keep (none named score).

    Null, empty and wordless texts score the share of label 1 among the labelled. Equal texts score alike; ties among
    neighbours change nothing but which of equally similar rows vote. An empty table gives no rows."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *more)
    first = 0 if "text" in keep else 1
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[first:]) + ", score double"

    def run(batches):
        m = shared.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for i, j, *found in term_counts(batch.column(0)):
                s[i:j] = vote(j - i, *found, m)
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(s)], names=[*batch.schema.names[first:], "score"])

    return rows.mapInArrow(run, schema)


def learn_from(labels: DataFrame) -> DataFrame:
    """The rows of labels that may be learnt from: crc32 of doc_id as text, modulo 3, is not 1."""
    return labels.filter(id_crc(F.col("doc_id")) % 3 != 1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs, fit(docs, learn_from(labels)))
    held = F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
