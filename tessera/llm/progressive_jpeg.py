"""Media columns as progressive JPEG (operator 7).

Reading: every scan adds to coefficient arrays, first passes of a band at reduced precision, refinements bit by bit;
then numpy dequantises, transforms back, upsamples chroma and returns full-resolution RGB tensors.

Writing: any bytes are stored losslessly as quantised coefficients, one byte each, in a valid 4:2:0 progressive file
(bands 0, 1-5, 6-63, each a first pass and a refinement). A byte b becomes the coefficient b + 256, whose magnitude class is
always the same, so entropy-coded segments are of fixed stride and both directions run vectorised. Scans of other
files take the general bit-by-bit path of the same reader."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tune


def _zigzag() -> np.ndarray:
    """Raster index of each coefficient in scan order: diagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: BASIS[u, x]: the inverse transform of one dimension.
BASIS = (np.where(_k == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) / 2).astype(np.float32)
MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
UNIT, MCU = 192, 384


@dataclass
class Component:
    h: int
    v: int
    table: int
    across: int = 0  # blocks of the component itself, as scans of one component count them
    down: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _one_code(klass: int, table: int, symbol: int, length: int) -> bytes:
    return bytes([klass << 4 | table, *(int(i == length) for i in range(1, 17)), symbol])


#: Tables of a single code each: class 8 for direct terms, (run 0, class 8) for others, end of band.
_TABLES = _segment(0xC4, _one_code(0, 0, 8, 8) + _one_code(1, 0, 8, 1) + _one_code(1, 1, 0, 1))
_SCANS = [(dc, table, lo, hi, ah, al) for dc, table, lo, hi, ah, al in ((0, 0, 0, 0, 0, 1), (0, 0, 1, 5, 0, 1), (0, 0, 6, 63, 0, 1), (0, 1, 1, 63, 1, 0), (0, 0, 0, 0, 1, 0))]
_HEADS = {(s, c): _segment(0xDA, bytes([1, c + 1, s[1] if s[2] else 0, s[2], s[3], s[4] << 4 | s[5]])) for s in _SCANS for c in range(3)}
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_RESTART, _NO_RESTART = _segment(0xDD, b"\0\1"), _segment(0xDD, b"\0\0")


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of a bit array, filled up with ones, with stuffing."""
    bits = bits.ravel()
    if fill := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(fill, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of payload, a positive multiple of UNIT."""
    units = -(-len(payload) // MCU)
    across = min(units, max(64, -(-units // 4095)))
    down = -(-units // across)
    total = across * down * MCU
    b = np.frombuffer(payload + b" " * (total - len(payload)), np.uint8).reshape(-1, 64)
    n = across * down
    parts = [b[: 4 * n], b[4 * n : 5 * n], b[5 * n :]]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _QUANT]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_TABLES, _RESTART]
    for c, x in enumerate(parts):
        # predictions start anew at each block: a zero code byte, the value's upper bits, a restart marker
        rows = np.zeros((len(x), 4), np.uint8)
        rows[:, 1] = (x[:, 0] >> 1) | 128
        rows[:, 2] = 255
        rows[:, 3] = 0xD0 + np.arange(len(x)) % 8
        flat = rows.ravel()[:-2]
        if (full := np.flatnonzero(rows[:, 1] == 255)).size:
            flat = np.insert(flat, 4 * full + 2, 0)
        out += [_HEADS[_SCANS[0], c], flat.tobytes()]
    out.append(_NO_RESTART)
    for s in _SCANS[1:]:
        for c, x in enumerate(parts):
            if s[4] == 0:
                band = np.ascontiguousarray(x[:, s[2] : s[3] + 1]).reshape(-1, 1)
                bits = np.zeros((len(band), 9), np.uint8)
                bits[:, 1:] = np.unpackbits((band >> 1) | 128, axis=1)
            elif s[2]:
                bits = x & 1
                bits[:, 0] = 0  # the end-of-band code stands where the direct term would
            else:
                bits = x[:, 0] & 1
            out += [_HEADS[s, c], _packed(bits)]
    return b"".join([*out, b"\xff\xd9"])


class Bits:
    """A bit reader over one entropy-coded segment: peek[i] is the 16 bits from bit i on."""

    def __init__(self, data: bytes):
        b = np.unpackbits(np.frombuffer(data + b"\xff" * 4, np.uint8)).astype(np.uint16)
        n = len(b) - 16
        acc = np.zeros(n, np.uint16)
        for i in range(16):
            acc |= b[i : i + n] << np.uint16(15 - i)
        self.peek, self.at = acc.tolist(), 0

    def code(self, lut) -> int:
        length, symbol = lut[self.peek[self.at]]
        if not length:
            raise ValueError("unknown code")
        self.at += length
        return symbol

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        x = self.peek[self.at] >> (16 - n)
        self.at += n
        return x

    def value(self, n: int) -> int:
        x = self.take(n)
        return x if n == 0 or x >> (n - 1) else x - (1 << n) + 1


class Table:
    """A Huffman table: its single code, if it has one only, and a lookup over 16 bits, made when first needed."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols, self._lut = counts, symbols, None
        self.single = (next(i + 1 for i, c in enumerate(counts) if c), symbols[0]) if sum(counts) == 1 else None

    @property
    def lut(self):
        if self._lut is None:
            out, code, k = [(0, 0)] * 65536, 0, 0
            for i, c in enumerate(self.counts):
                for _ in range(c):
                    lo = code << (15 - i)
                    out[lo : lo + (1 << (15 - i))] = [(i + 1, self.symbols[k])] * (1 << (15 - i))
                    code, k = code + 1, k + 1
                code <<= 1
            self._lut = out
        return self._lut


def _plain(data: bytes) -> list[bytes]:
    """Restart segments of entropy-coded data, without stuffing."""
    return [x.replace(b"\xff\0", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)]


def _fixed_scan(data: bytes, comp: Component, table: Table | None, lo: int, hi: int, ah: int, al: int, restart: int) -> bool:
    """Reads a scan whose codes all have one length, as whole arrays; False if it isn't one."""
    n, band = comp.across * comp.down, hi - lo + 1
    flat = comp.coef[: comp.down, : comp.across].reshape(n, 64) if comp.coef.shape[:2] == (comp.down, comp.across) else None
    if flat is None:
        return False
    if lo == 0 and ah:
        if restart:
            return False
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[:n]
        if len(bits) < n:
            raise ValueError("short scan")
        flat[:, 0] |= bits.astype(np.int32) << al
        return True
    if table is None or table.single is None:
        return False
    length, symbol = table.single
    if not ah:
        size = symbol & 15
        if symbol != size or size != 8 or restart not in ((1,) if lo == 0 else (0,)):
            return False
        raw = np.frombuffer(data, np.uint8)
        if restart:
            if length != 8:
                return False
            # drop stuffing and restart markers; what is left are two bytes a block
            after = np.concatenate([[False], raw[:-1] == 255])
            marker = after & (raw >= 0xD0)
            keep = ~(after & ((raw == 0) | marker))
            keep[:-1] &= ~marker[1:]
            two = raw[keep]
            if len(two) != 2 * n or two[::2].any():
                raise ValueError("bad direct terms")
            value = two[1::2].astype(np.int32)
        else:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: n * band * (length + size)]
            if len(bits) < n * band * (length + size):
                raise ValueError("short scan")
            bits = bits.reshape(-1, length + size)
            if bits[:, :length].any():
                raise ValueError("unknown code")
            value = np.packbits(bits[:, length:], axis=1)[:, 0].astype(np.int32)
        value = np.where(value < 128, value - 255, value) if (value < 128).any() else value
        flat[:, lo : hi + 1] = value.reshape(n, band) << al
        return True
    if symbol != 0 or restart or not flat[:, lo : hi + 1].all():
        return False
    bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: n * (length + band)]
    if len(bits) < n * (length + band):
        raise ValueError("short scan")
    bits = bits.reshape(n, length + band)
    if bits[:, :length].any():
        raise ValueError("unknown code")
    now = flat[:, lo : hi + 1]
    more = bits[:, length:].astype(np.int32) << al
    now += more if (now > 0).all() else np.where(now > 0, more, -more)
    return True


def _scan(data: bytes, comps: list[Component], dc: list, ac: list, lo: int, hi: int, ah: int, al: int, restart: int, units: tuple[int, int]) -> None:
    """The general path: block by block, bit by bit."""
    if len(comps) == 1:
        c = comps[0]
        order = [[(0, r, k)] for r in range(c.down) for k in range(c.across)]
    else:
        order = [[(i, r * c.v + y, k * c.h + x) for i, c in enumerate(comps) for y in range(c.v) for x in range(c.h)] for r in range(units[1]) for k in range(units[0])]
    segments = iter(_plain(data))
    bits, last, run = Bits(next(segments)), [0] * len(comps), 0
    plus, minus = 1 << al, -1 << al
    for m, unit in enumerate(order):
        if restart and m and m % restart == 0:
            bits, last, run = Bits(next(segments)), [0] * len(comps), 0
        for i, r, k in unit:
            block = comps[i].coef[r, k]
            if lo == 0:
                if ah:
                    block[0] |= bits.take(1) << al
                else:
                    last[i] += bits.value(bits.code(dc[i].lut))
                    block[0] = last[i] << al
                continue
            at, lut = lo, ac[i].lut
            if not ah:
                if run:
                    run -= 1
                    continue
                while at <= hi:
                    skip, size = divmod(bits.code(lut), 16)
                    if size:
                        at += skip
                        block[at] = bits.value(size) * plus
                        at += 1
                    elif skip == 15:
                        at += 16
                    else:
                        run = (1 << skip) + bits.take(skip) - 1
                        break
                continue
            if not run:
                while at <= hi:
                    skip, size = divmod(bits.code(lut), 16)
                    new = 0
                    if size:
                        new = plus if bits.take(1) else minus
                    elif skip < 15:
                        run = (1 << skip) + bits.take(skip)
                        break
                    while at <= hi:
                        if block[at]:
                            if bits.take(1):
                                block[at] += plus if block[at] > 0 else minus
                        else:
                            if skip == 0:
                                if new:
                                    block[at] = new
                                at += 1
                                break
                            skip -= 1
                        at += 1
            if run:
                while at <= hi:
                    if block[at] and bits.take(1):
                        block[at] += plus if block[at] > 0 else minus
                    at += 1
                run -= 1


@dataclass
class Image:
    width: int
    height: int
    comps: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


def read(data: bytes, fast: bool = True) -> Image:
    """The coefficients of a progressive JPEG (8 bits a sample, 1 or 3 components); ValueError if it is damaged or another kind."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, image, restart = 2, {}, None, 0
    ids, quant, comment = {}, {}, b""
    while True:
        if at + 2 > len(data) or data[at] != 255:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                n = sum(counts)
                key = body[i : i + 17 + n]
                tables[body[i]] = _cached(key[1:17], key[17:])
                i += 17 + n
        elif kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                i += 65 + 64 * wide
        elif kind == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("unsupported frame")
            comps = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            top_h, top_v = max(c.h for c in comps), max(c.v for c in comps)
            units = (-(-width // (8 * top_h)), -(-height // (8 * top_v)))
            for i, c in enumerate(comps):
                ids[body[6 + 3 * i]] = c
                c.across, c.down = -(-(-(-width * c.h // top_h)) // 8), -(-(-(-height * c.v // top_v)) // 8)
                c.coef = np.zeros((units[1] * c.v, units[0] * c.h, 64), np.int32)
            image = Image(width, height, comps, quant)
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not progressive")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2])
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            m = MARKER.search(data, at)
            if image is None or not m:
                raise ValueError("scan without end")
            raw, at = data[at : m.start()], m.start()
            n = body[0]
            part = [ids[body[1 + 2 * i]] for i in range(n)]
            sel = [body[2 + 2 * i] for i in range(n)]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            ah, al = divmod(approx, 16)
            dc, ac = [tables.get(s >> 4) for s in sel], [tables.get(16 | s & 15) for s in sel]
            if not (fast and n == 1 and _fixed_scan(raw, part[0], dc[0] if lo == 0 else ac[0], lo, hi, ah, al, restart)):
                _scan(raw, part, dc, ac, lo, hi, ah, al, restart, units)
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


_known: dict[tuple[bytes, bytes], Table] = {}


def _cached(counts: bytes, symbols: bytes) -> Table:
    if len(_known) > 256:
        _known.clear()
    return _known.setdefault((counts, symbols), Table(counts, symbols))


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component at full resolution, as float32 about 0 to 255."""
    top_h, top_v = max(c.h for c in image.comps), max(c.v for c in image.comps)
    out = []
    for c in image.comps:
        down, across, _ = c.coef.shape
        flat = np.empty((down * across, 64), np.float32)
        flat[:, ZIGZAG] = c.coef.reshape(-1, 64) * image.quant[c.table]
        rows = (flat.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        cells = (np.ascontiguousarray(rows).reshape(-1, 8) @ BASIS).reshape(down, across, 8, 8)
        # cells[..., x, y]: the second product ran over the first dimension
        plane = cells.transpose(0, 3, 1, 2).reshape(down * 8, across * 8) + np.float32(128)
        if top_v != c.v:
            plane = plane.repeat(top_v // c.v, axis=0)
        if top_h != c.h:
            plane = plane.repeat(top_h // c.h, axis=1)
        out.append(plane[: image.height, : image.width])
    return out


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8."""
    p = planes(image)
    if len(p) == 1:
        p = [p[0], np.float32(128), np.float32(128)]
    y, cb, cr = p[0], p[1] - np.float32(128), p[2] - np.float32(128)
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[..., i] = np.clip(np.rint(x), 0, 255)
    return out


def payload(image: Image) -> bytes:
    """The bytes that store() put in."""
    m = re.fullmatch(rb"payload (\d+)", image.comment)
    if not m:
        raise ValueError("holds no payload")
    return np.concatenate([c.coef.ravel() for c in image.comps]).astype(np.uint8).tobytes()[: int(m[1])]


def feature(tensor: np.ndarray) -> str:
    """Width, height, sum of each colour and a 2 x 2 map of brightness sums."""
    h, w, _ = tensor.shape
    sums = tensor.sum(axis=(0, 1), dtype=np.int64)
    rows = tensor.sum(axis=2, dtype=np.int32)
    halves = [int(rows[a, b].sum(dtype=np.int64)) for a in (slice(0, h // 2), slice(h // 2, h)) for b in (slice(0, w // 2), slice(w // 2, w))]
    return f"{w}x{h}:" + ",".join(map(str, [*sums.tolist(), *halves]))


def store_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a progressive JPEG. Extra columns are ignored."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                data = (x or "").encode()
                sizes.append(len(data))
                media.append(store(pad(data)))
                if sum(map(len, media)) > 16_000_000 or i == batch.num_rows - 1:
                    lo = i + 1 - len(media)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    sizes, media = [], []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """media (column media: progressive JPEG) with width, height and rgb, the interleaved samples, row by row.

    A null or damaged file gives nulls and a reason in error."""
    schema = ", ".join(f"`{n}` {t}" for n, t in media.dtypes) + ", width int, height int, rgb binary, error string"
    at = media.columns.index("media")

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(at).to_pylist():
                try:
                    image = read(x or b"")
                    out.append((image.width, image.height, rgb(image).tobytes(), None))
                except (ValueError, IndexError, KeyError, StopIteration, struct.error, AttributeError) as e:
                    out.append((None, None, None, str(e) or type(e).__name__))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            new = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "width", "height", "rgb", "error"])

    return media.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What the stored files say, read back: payload digests, and a feature of the RGB tensor.

    An empty text is one unit of spaces. Rows that repeat a doc_id are read apart; equal texts give equal values; an
    empty table gives no rows."""

    def run(batches):
        for batch in batches:
            out = []
            for i, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = read(x)
                p = payload(image)
                out.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(x), hashlib.sha256(x).hexdigest(), feature(rgb(image))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)
