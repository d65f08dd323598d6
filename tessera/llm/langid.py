"""Language identification (operator 3): sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of n-grams of one to three characters are hashed into TERMS buckets; document frequencies count all documents
that may be learnt from.
The model is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample (PER_LANGUAGE rows
of each language), and its temperature is calibrated on a fifth of that sample that training never saw."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, id_crc, tune
from tessera.llm.quality import document_frequencies, products, sample_counts, sparse, weighted
from tessera.llm.words import mix

TERMS = 1 << 14
#: The bound of the fit: about so many labelled rows of each language.
PER_LANGUAGE = 1200
#: Characters counted at once; a longer text is a chunk of its own.
CHUNK = 800_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 2
UNKNOWN = "und"

_ascii = np.full(128, 32, np.uint32)
_ascii[65:91], _ascii[97:123] = np.arange(97, 123), np.arange(97, 123)


def gram_counts(arr: pa.Array):
    """(from, to, rows, terms, counts) over the rows of a text column: the terms that each row holds. Letters are
    lower-cased, other ASCII is a blank, runs of blanks are one."""
    texts = arr.to_pylist()
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "")
            j += 1
        part = [f" {(t or '').lower()} " for t in texts[i:j]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(j - i), [len(t) for t in part])
        low = codes < 128
        codes = np.where(low, _ascii[np.where(low, codes, 0)], codes)
        blank = codes == 32
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
        codes, doc, blank = codes[keep].astype(np.uint64), doc[keep], blank[keep]
        cells = []
        h = codes
        for n in (1, 2, 3):
            if n > 1:
                h = h[: len(codes) - n + 1] * np.uint64(0x1000193) + codes[n - 1 :] * np.uint64(2 * n + 1)
            ok = doc[: len(h)] == doc[n - 1 : n - 1 + len(h)] if len(h) else np.zeros(0, bool)
            if n == 1:
                ok = ok & ~blank
            cells.append(doc[: len(h)][ok] * TERMS + (mix(h[ok], n) & np.uint64(TERMS - 1)).astype(np.int64))
        yield i, j, *sparse(np.concatenate(cells), TERMS)
        i = j


class Model(NamedTuple):
    languages: list[str]
    weight: np.ndarray
    matrix: np.ndarray  # (TERMS, languages), mostly zeros
    bias: np.ndarray
    temperature: float


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray]  # terms and their values


def ftrl(rows: list[Row], y: np.ndarray, terms: int, classes: int, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial model; y: class numbers. Only the weights of a row's terms are updated by it."""
    z, n = np.zeros((terms + 1, classes)), np.zeros((terms + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at = np.append(rows[r][0].astype(np.int64), terms)
            v = np.append(rows[r][1], 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(v @ w)
            p[y[r]] -= 1
            g = v[:, None] * p[None, :]
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - step * w
            n[at] = ns + g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from learn (doc_id, text, lang), document counts too; rows with a null lang or text are left out."""
    tune(learn.sparkSession)
    known = learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text")).filter("label IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(known.select("text"), gram_counts, TERMS)
    weight = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    labels, pairs = sample_counts(bounded_sample(known, "label", per_language, seed=11), gram_counts, TERMS)
    languages = sorted(set(labels))
    if not languages:
        return Model([], weight, np.zeros((TERMS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    y = np.array([languages.index(v) for v in labels])
    rows = [(at, weighted(1, np.zeros(len(at), np.int64), at.astype(np.int64), n_of.astype(np.float32), weight)) for at, n_of in pairs]
    apart = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    w, b = ftrl([rows[i] for i in np.flatnonzero(~apart)], y[~apart], TERMS, len(languages))
    if len(languages) == 1:
        return Model(languages, weight, w, b, 1.0)
    seen = np.flatnonzero(apart if apart.any() else ~apart)
    return Model(languages, weight, w, b, calibrate(np.array([rows[i][1] @ w[rows[i][0]] + b for i in seen]), y[seen]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text); `und` with score 0 if the text is null or has no letter.

    Whole texts are counted. Equal texts are predicted alike; of equal probabilities the first language in code-point
    order wins. Rows with a null doc_id are predicted as any other. An empty table gives no rows. Extra columns are ignored."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
            if m.languages:
                for i, j, row, term, n in gram_counts(batch.column(1)):
                    p = softmax((products(j - i, row, term, weighted(j - i, row, term, n, m.weight), m.matrix) + m.bias) / m.temperature)
                    best = p.argmax(1)
                    for r in range(i, j):
                        if letters[r]:
                            lang[r], score[r] = m.languages[best[r - i]], p[r - i, best[r - i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows whose crc32 of doc_id as text, modulo 4, is not 2. A null
    doc_id has no such remainder: the row is neither learnt from nor held out."""
    out = predict(docs, fit(docs.filter(id_crc(F.col("doc_id")) % 4 != 2)))
    held = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
