"""Personal data: strict patterns, and weakly supervised spans beside them (operator 9).

Candidates are what loose patterns find. Labelers vote on each: a strict pattern with its check, gazetteers (top-level
domains, calling codes, issuer prefixes, reserved networks), context words before it, and shape. Votes over all
documents are counted by pattern, a bounded table whatever the corpus; expectation-maximisation on it estimates each
labeler's reliability per kind, and its posteriors train a final classifier of spans (a logistic regression on the
votes and their pairs). Strict spans always stay; the classifier adds candidates that do not overlap them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, tune

KINDS = ("email", "ip", "card", "phone")
#: What stands left of an address's @, and right of it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match starts where a run of digits does, as the run's other places have the same to their right.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser than the strict ones: octets in brackets, cards by other separators, national numbers; of bounded lengths.
LOOSE = {
    "ip": re.compile(r"[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[ ./_-]?[0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9]|\.[0-9])"),
}
#: What a loose match of a kind must hold; much cheaper to look for.
HINT = {"ip": re.compile(r"\[\.\]"), "card": re.compile(r"[0-9]{4}[ ./_-]?[0-9]{4}"), "phone": re.compile(r"[0-9]{3}[-. ][0-9]{4}")}
#: Spelled-out addresses.
AT = re.compile(r"\[at\]|\(at\)")
SPELLED = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+")
#: Words that speak for a kind when they stand just before a span.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|courriel|correo)\W*$"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|adresse|servidor)\W*$"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|carte|karte|tarjeta)\W*$"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|t[ée]l[ée]phone|tel[ée]fono)\W*$"),
}
#: What a kind is often mistaken for: versions, sums, dates, identifiers.
AGAINST = re.compile(r"(?i)(?:\b(?:version|ver|v|isbn|issn|doi|sku|order|invoice|no|nr|id)\W*|[$€£#=/_])$")
TOP = frozenset("com net org edu gov io info biz de fr es uk eu us ch at it nl".split())
RESERVED = frozenset((0, 127, 255))
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
#: Labelers, in vote order.
LABELERS = ("strict", "gazetteer", "context", "against", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _run_start(text: str, end: int, least: int) -> int:
    """Where the run of address characters begins that ends at end, at least at least."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def _emails(text: str):
    """Leftmost matches of an address: every @ is looked at once, with the run to its left and the domain to its right."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = _run_start(text, at, done)
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _spelled(text: str):
    done = 0
    for m in AT.finditer(text):
        if m.start() < done:
            continue
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        lo = _run_start(text, end, done)
        tail = SPELLED.match(text, m.end()) if lo < end else None
        if tail:
            yield lo, tail.end()
            done = tail.end()


def strict(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of leftmost non-overlapping matches of each kind that pass its check, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if text.count(".") >= 3:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def loose(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the loose patterns find."""
    out = [(a, 0, b) for a, b in _spelled(text)]
    return sorted(out + [(m.start(), k, m.end()) for k, name in enumerate(KINDS) if name in LOOSE and HINT[name].search(text) for m in LOOSE[name].finditer(text)])


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, strict) of the strict matches and of the loose ones that overlap none of them."""
    base = strict(text)
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    free = [(a, k, b) for a, k, b in loose(text) if not (i := bisect_left(starts, b)) or ends[i - 1] <= a]
    return [(*x, True) for x in base] + [(*x, False) for x in free]


def votes(text: str, start: int, kind: int, end: int, is_strict: bool) -> int:
    """The labelers' votes packed in base 3: 0 against, 1 abstains, 2 for."""
    name, s, before = KINDS[kind], text[start:end], text[max(0, start - 24) : start]
    v = [2 if is_strict else 1]
    d = _digits(s)
    if name == "email":
        gazetteer = 2 if re.split(r"\W+", s.rstrip(")]"))[-1].lower() in TOP else 0
        shape = 2 if not re.search(r"\.\.|@[.-]", s) else 0
    elif name == "ip":
        first = int(re.split(r"\D+", s)[0][-6:])
        gazetteer = 0 if first in RESERVED else 2
        shape = 2 if all(x == "0" or x[0] != "0" for x in re.findall(r"[0-9]+", s)) and (text[end : end + 1] != "." or not text[end + 1 : end + 2].isdigit()) else 0
    elif name == "card":
        gazetteer = 2 if d.startswith(ISSUERS) else 0
        shape = 2 if luhn(d) and len(set(d)) > 2 else 0
    else:
        gazetteer = 2 if s[0] == "+" and d[0] != "0" or s[0] != "+" and len(d) == 10 and d[0] not in "01" and d[3] not in "01" else 0
        shape = 2 if s.count("(") == s.count(")") and not re.search(r"[ .-]{3}", s) else 0
    v.append(gazetteer)
    v.append(2 if CONTEXT[name].search(before) else 1)
    v.append(0 if AGAINST.search(before) else 1)
    v.append(shape)
    code = 0
    for x in v:
        code = code * 3 + x
    return code


def _unpack(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        out.append(x)
    return out[::-1]


SPANS = "doc_id long, spans array<struct<start: int, stop: int, kind: int, base: boolean, votes: int>>"


def _spans(batches):
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            out.append([{"start": a, "stop": b, "kind": k, "base": sure, "votes": votes(text, a, k, b, sure)} for a, k, b, sure in candidates(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], names=["doc_id", "spans"])


def estimate(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """(posterior of each (kind, votes), reliabilities[kind, labeler, truth, vote]) by expectation-maximisation.

    Labelers are taken as independent given the truth; abstaining says nothing; counts are smoothed; the start is the
    share of votes for."""
    rel = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 2)
    rel[..., 1] = 1
    post = {}
    for k in range(len(KINDS)):
        rows = [(c, n) for (kind, c), n in sorted(counts.items()) if kind == k]
        if not rows:
            continue
        v = np.array([_unpack(c) for c, _ in rows])
        n = np.array([x for _, x in rows], float)
        p = np.clip(((v == 2).sum(1) + 0.5) / ((v != 1).sum(1) + 1), 0.05, 0.95)
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            for j in range(len(LABELERS)):
                for t, w in ((1, n * p), (0, n * (1 - p))):
                    hits = np.array([w[v[:, j] == x].sum() for x in (0, 2)]) + 0.5
                    rel[k, j, t, [0, 2]] = hits / hits.sum()
            log = [np.log(x) + sum(np.log(rel[k, j, t, v[:, j]]) for j in range(len(LABELERS))) for t, x in ((1, prior), (0, 1 - prior))]
            p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        post |= {(k, c): float(x) for (c, _), x in zip(rows, p, strict=True)}
    return post, rel


def features(kind: int, code: int) -> np.ndarray:
    """Kind, votes and pairs of votes (without the strict labeler, which a candidate never has), one-hot."""
    v = _unpack(code)[1:]
    x = np.zeros(len(KINDS) + 3 * len(v) + 9 * len(v) * (len(v) - 1) // 2 + 1)
    x[kind], x[-1] = 1, 1
    for j, y in enumerate(v):
        x[len(KINDS) + 3 * j + y] = 1
    for i, (a, b) in enumerate(combinations(range(len(v)), 2)):
        x[len(KINDS) + 3 * len(v) + 9 * i + 3 * v[a] + v[b]] = 1
    return x


def train(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], rounds: int = 400, ridge: float = 0.05) -> np.ndarray:
    """Weights of the span classifier: logistic regression on soft labels, every vote pattern weighted by its share."""
    if not counts:
        return np.zeros(len(features(0, 0)))
    keys = sorted(counts)
    x = np.array([features(*k) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= n.sum()
    y = np.array([post[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= 2.0 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + ridge / 100 * w)
    return w


def find(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (strict ones), base_sha256, spans, n_added for each row of docs (doc_id, text).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Texts are searched whole. Rows that
    repeat a doc_id are searched apart. An empty table trains nothing and gives no rows. Extra columns are ignored."""
    tune(docs.sparkSession)
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_spans, SPANS), "spans")
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    counts = {(r["kind"], r["votes"]): r["count"] for r in rows}
    post, _ = estimate(counts)
    weights = train(counts, post)
    yes = {k for k in counts if 1 / (1 + np.exp(-features(*k) @ weights)) >= least}

    def finish(batches):
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                base = [(s["start"], s["kind"], s["stop"]) for s in spans if s["base"]]
                more = [(s["start"], s["kind"], s["stop"]) for s in spans if not s["base"] and (s["kind"], s["votes"]) in yes]
                text = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(x)) for x in (base, base + more)]
                out.append((*(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(more)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return found.mapInArrow(finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
