"""Plain Python versions of the operators that roll, rank or recurse. None is null, nan is NaN."""

import math
from statistics import NormalDist, fmean, pstdev

NAN = float("nan")


def ok(x):
    return x is not None and x == x


def window(xs, i, d):
    return xs[max(0, i - d + 1) : i + 1]


def per_row(fn):
    return lambda xs, *a: [fn(xs, i, *a) for i in range(len(xs))]


@per_row
def ts_product(xs, i, d):
    w = window(xs, i, d)
    return math.prod(w) if all(map(ok, w)) else NAN


@per_row
def ts_rank(xs, i, d, constant=0):
    v = [x for x in window(xs, i, d) if ok(x)]
    if not ok(xs[i]):
        return NAN
    return constant + (0.5 if len(v) == 1 else sum(x < xs[i] for x in v) / (len(v) - 1))


@per_row
def ts_quantile(xs, i, d):
    v = [x for x in window(xs, i, d) if ok(x)]
    if not ok(xs[i]):
        return NAN
    return 0.0 if len(v) == 1 else NormalDist().inv_cdf((sum(x < xs[i] for x in v) + 0.5) / len(v))


@per_row
def ts_arg_max(xs, i, d):
    if i + 1 < d or not ok(xs[i]):
        return NAN
    v = [(x, j) for j, x in enumerate(window(xs, i, d)) if ok(x)]
    return float(d - 1 - max(v)[1])


@per_row
def ts_arg_min(xs, i, d):
    if i + 1 < d or not ok(xs[i]):
        return NAN
    v = [(x, -j) for j, x in enumerate(window(xs, i, d)) if ok(x)]
    return float(d - 1 + min(v)[1])


@per_row
def last_diff_value(xs, i, d):
    if not ok(xs[i]):
        return NAN
    for x in reversed(window(xs, i, d)[:-1]):
        if ok(x) and x != xs[i]:
            return x
    return NAN


@per_row
def ts_decay_linear(xs, i, d):
    w = window(xs, i, d)
    if len(w) < d or not all(map(ok, w)):
        return NAN
    return sum((j + 1) * x for j, x in enumerate(w)) / (d * (d + 1) / 2)


@per_row
def ts_backfill(xs, i, d):
    for x in reversed(xs[max(0, i - d) : i + 1]):
        if x is not None:
            return x
    return None


def days_from_last_change(xs):
    out, last = [], 0
    for i, x in enumerate(xs):
        if i:
            p = xs[i - 1]
            same = x is None and p is None or x is not None and p is not None and x == p
            if not same:
                last = i
        out.append(i - last)
    return out


def hump(rows, factor):
    """rows: {symbol: values}."""
    n = len(next(iter(rows.values())))
    limit = [factor * sum(abs(v[i]) for v in rows.values() if ok(v[i])) for i in range(n)]
    out = {}
    for s, v in rows.items():
        y = []
        for i, x in enumerate(v):
            if i == 0 or not ok(x) or not ok(y[-1]):
                y.append(x if x is not None else NAN)
            else:
                step = x - y[-1]
                y.append(y[-1] + math.copysign(min(abs(step), limit[i]), step) if step else y[-1])
        out[s] = y
    return out


def trade_when(trade, alpha, leave):
    out, now = [], NAN
    for t, a, e in zip(trade, alpha, leave, strict=True):
        if ok(e) and e > 0:
            now = NAN
        elif ok(t) and t > 0:
            now = a if a is not None else NAN
        out.append(now)
    return out


def regression(ys, xs, i, d, kind):
    w = list(zip(window(ys, i, d), window(xs, i, d), strict=True))
    if len(w) < d or not all(ok(a) and ok(b) for a, b in w):
        return NAN
    my, mx = sum(a for a, _ in w) / d, sum(b for _, b in w) / d
    sxx, syy = sum((b - mx) ** 2 for _, b in w), sum((a - my) ** 2 for a, _ in w)
    sxy = sum((a - my) * (b - mx) for a, b in w)
    if sxx == 0:
        return NAN
    beta = sxy / sxx
    alpha = my - beta * mx
    if kind < 4:
        return [ys[i] - alpha - beta * xs[i], beta, alpha, alpha + beta * xs[i]][kind]
    if kind < 6:
        if syy == 0:
            return NAN
        r = sxy / math.sqrt(sxx * syy)
        return r if kind == 4 else r * r
    rest = syy - beta * sxy
    if d <= 2 or rest <= 0:
        return NAN
    sb, sa = math.sqrt(rest / (d - 2) / sxx), math.sqrt(rest / (d - 2) * (1 / d + mx * mx / sxx))
    return [beta / sb, alpha / sa, sb, sa][kind - 6]


def group_backfill(x, g, group, i, d, std):
    """What fills a missing value of the group on day i."""
    seen = [x[s][k] for s in x for k in range(max(0, i - d + 1), i + 1) if g[s][k] == group and ok(x[s][k])]
    if group is None or not seen:
        return None
    mean, dev = fmean(seen), pstdev(seen)
    return fmean(max(mean - std * dev, min(mean + std * dev, v)) for v in seen)
