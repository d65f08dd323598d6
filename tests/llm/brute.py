"""Plain versions of the contracts, for comparison on small tables."""

from collections import defaultdict


def shingles(text, k):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(docs, k=4, percent=80):
    """{doc_id: (n, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = set()
    for d, s in sets.items():
        count = defaultdict(int)
        for x in s:
            for o in where[x]:
                if o < d:
                    count[o] += 1
        for o, c in count.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c) and (o, d) not in seen:
                seen.add((o, d))
                a, b = find(o), find(d)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, size=20):
    """{doc_id: (words, removed, sha256 of the kept)} of rows with distinct ids."""
    import hashlib

    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def tiling(item, text, least):
    """Words of item covered by greedy string tiling, by the plain definition."""
    pm, tm, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best, found = least, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not pm[p + n] and not tm[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best:
                    found.append((p, t))
        if not found:
            return covered
        for p, t in found:
            if not any(pm[p : p + best]) and not any(tm[t : t + best]):
                pm[p : p + best] = tm[t : t + best] = [True] * best
                covered += best


def mix(docs, weights=(5, 2, 1), percent=150, most=2):
    """{source: target} by the plain rule, iterating."""
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()) * percent / 100, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def flow_cost(blocks, shards):
    """Least bytes moved if every row is a unit at its block's mean size, by trying all ways of few rows (see the test)."""
    from itertools import product

    rows = [(b[0], -(-b[3] // b[2])) for b in blocks for _ in range(b[2])]
    base, more = divmod(len(rows), shards)
    best = None
    for to in product(range(shards), repeat=len(rows)):
        counts = [to.count(s) for s in range(shards)]
        if sorted(counts) != [base] * (shards - more) + [base + 1] * more:
            continue
        cost = sum(c for (old, c), s in zip(rows, to, strict=True) if old != s)
        best = cost if best is None else min(best, cost)
    return best


def personal(text):
    """[(start, kind, end)] by the contract's patterns over the whole text."""
    import re

    from tessera.llm.pii import luhn

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def agreement(counts, labelers, rounds=50):
    """{votes: posterior} of one kind by expectation-maximisation in plain Python; counts: {tuple of votes 0, 1, 2: n}."""
    from math import exp, log

    p = {v: min(0.95, max(0.05, (sum(x == 2 for x in v) + 0.5) / (sum(x != 1 for x in v) + 1))) for v in counts}
    for _ in range(rounds):
        prior = (sum(counts[v] * p[v] for v in counts) + 1) / (sum(counts.values()) + 2)
        rel = {}
        for j in range(labelers):
            for t in (0, 1):
                hits = {x: 0.5 + sum(n * (p[v] if t else 1 - p[v]) for v, n in counts.items() if v[j] == x) for x in (0, 2)}
                rel |= {(j, t, x): h / sum(hits.values()) for x, h in hits.items()} | {(j, t, 1): 1}
        for v in counts:
            yes, no = (log(q) + sum(log(rel[j, t, x]) for j, x in enumerate(v)) for t, q in ((1, prior), (0, 1 - prior)))
            p[v] = 1 / (1 + exp(max(-50, min(50, no - yes))))
    return p


def grams(text, terms):
    """{bucket: count} of the runs of one to three characters, as the language identifier counts them, in plain integers."""
    from collections import Counter

    m = (1 << 64) - 1

    def mixed(h, salt):
        h = (h + 0x9E3779B97F4A7C15 * (salt + 1)) & m
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
        return h ^ (h >> 31)

    codes = []
    for c in f" {text.lower()} ":
        c = c if ord(c) > 127 or c.isalpha() else " "
        if c != " " or not codes or codes[-1] != 32:
            codes.append(ord(c))
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            if n == 1 and codes[i] == 32:
                continue
            h = codes[i]
            for k in range(2, n + 1):
                h = (h * 0x1000193 + codes[i + k - 1] * (2 * k + 1)) & m
            out[mixed(h, n) % terms] += 1
    return dict(out)


def ftrl(rows, y, classes, order, alpha, beta, l1, l2):
    """{(term, class): weight} of a multinomial model, term None for the bias; rows: {term: value}; order: rows as seen."""
    from math import exp, sqrt

    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - (l1 if a > 0 else -l1)) / ((beta + sqrt(b)) / alpha + l2)

    for r in order:
        x = rows[r] | {None: 1.0}
        w = {(t, c): weight((t, c)) for t in x for c in range(classes)}
        logits = [sum(v * w[t, c] for t, v in x.items()) for c in range(classes)]
        e = [exp(v - max(logits)) for v in logits]
        for c in range(classes):
            off = e[c] / sum(e) - (y[r] == c)
            for t, v in x.items():
                g, key = v * off, (t, c)
                step = (sqrt(n.get(key, 0.0) + g * g) - sqrt(n.get(key, 0.0))) / alpha
                z[key] = z.get(key, 0.0) + g - step * w[key]
                n[key] = n.get(key, 0.0) + g * g
    return {k: weight(k) for k in z}
