"""Vectorised words and hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what `[^\\x20\\x09-\\x0D]+` finds in UTF-8 text.
Hashes are polynomials modulo 2**64 taken from one prefix sum per chunk, then mixed; two of them make 128 bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text hashed at once; a longer document is a chunk of its own.
CHUNK = 1_500_000
#: Values hashed at once.
PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads every bit of h over the word (the finaliser of a well-known 64-bit mixer)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, in order of start; equal contents, equal hash, wherever they stand.

    Spans that start within PIECE values are hashed together, so a long text needs no more memory than a short one and its
    longest span."""
    if len(values) <= PIECE:
        return _spans_hash(values, start, end)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        lo, j = int(start[i]), int(np.searchsorted(start, start[i] + PIECE))
        out[i:j] = _spans_hash(values[lo : int(end[i:j].max())], start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    term = values.astype(np.uint64)
    term += np.uint64(1)
    term *= up[:-1]
    np.cumsum(term, out=acc[1:])
    return mix((acc[end] - acc[start]) * down[start])


@dataclass
class Words:
    """Words of docs documents: byte spans in buf, the document of each, and where each document's words begin."""

    buf: np.ndarray
    docs: int
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # docs + 1 positions in start
    sizes: np.ndarray  # bytes of each document

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """Of each word; of what table says of its bytes, if given."""
        return spans_hash(self.buf if table is None else table[self.buf], self.start, self.end)

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all runs of k words within one document, and their hashes."""
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(h) - k + 1] == self.doc[k - 1 :])
        return at, spans_hash(h, at, at + k)


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def split(buf: np.ndarray, off: np.ndarray) -> Words:
    n, docs = len(buf), len(off) - 1
    gap = np.ones(n + 2, bool)
    gap[1:-1] = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    full = ~gap
    start = np.flatnonzero(full[1:-1] & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(full[1:-1] & (gap[2:] | edge[1:])) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Words(buf, docs, start, end, doc, np.searchsorted(doc, np.arange(docs + 1)), np.diff(off))


def chunks(arr: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) over the rows of a column, about CHUNK bytes at a time."""
    buf, off = column_bytes(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, j, split(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
