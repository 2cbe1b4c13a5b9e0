"""Media columns: progressive JPEG kept in a binary column, read back to full-resolution RGB tensors.

`store` writes any payload losslessly as a progressive JPEG whose quantized DCT coefficients are the
payload (the format's own unit): byte b is a coefficient of magnitude b + 256, 64 bytes fill a block in
zigzag order, 4:2:0 subsampling, quantizer 1, samples of 12 bits.  The signs are the same for all blocks and
look random, so that no sample gathers all coefficients at once: samples stay within their range and next to
none is clipped.  The scans are those of an ordinary progressive file: DC of
all components, two spectral bands of the luma and one of each chroma at reduced precision, then
successive-approximation refinements.  The Huffman tables give every symbol of a scan the same total
number of bits, so such a scan is packed and unpacked with numpy alone.

`read` takes any progressive Huffman JPEG of 8 or 12 bits with 1 or 3 components: it accumulates the scans in
coefficient arrays (spectral selection, successive approximation, end-of-band runs, restart
markers), inverse-transforms in numpy, upsamples chroma and converts to RGB.  Scans that are not of
uniform width are read bit by bit.

Defined results: a null or empty text is a payload of 192 spaces; equal texts give equal bytes;
repeated rows repeat; other columns are ignored.  Memory is bounded by one step of text per worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from weftgraph.llm._rows import bounded_batches, map_texts

UNIT = 192
SHIFT = 256
PRECISION = 12
#: Sign of each coefficient but the first, in zigzag order.
SIGNS = np.random.default_rng(64).choice([-1, 1], 64)
SIGNS[0] = 1
RUN_MAX = 32767


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _idct_matrix() -> np.ndarray:
    """(64 coefficients in zigzag order) @ this = 64 samples in row-major order."""
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.125), 0.5)[None, :]
    full = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return np.ascontiguousarray(full[ZIGZAG]).astype(np.float32)


IDCT = _idct_matrix()


# ---------------------------------------------------------------- writing


def _marker(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, at: int, lengths: dict[int, int]) -> bytes:
    """lengths: code length of each symbol."""
    return _table(kind, at, tuple(sorted((n, s) for s, n in lengths.items())))


@lru_cache(maxsize=256)
def _table(kind: int, at: int, order: tuple[tuple[int, int], ...]) -> bytes:
    """A table's segment; most pictures share theirs."""
    counts = bytearray(16)
    for n, _ in order:
        counts[n - 1] += 1
    return _marker(0xC4, bytes([kind << 4 | at]) + bytes(counts) + bytes(s for _, s in order))


def _scan(components: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([*band, high << 4 | low])
    fill = np.ones(-len(bits) % 8, dtype=np.uint8)
    return _marker(0xDA, head) + np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\x00")


def _words9(words: np.ndarray) -> np.ndarray:
    """Bits of 9-bit words."""
    out = np.empty((words.size, 9), dtype=np.uint8)
    flat = words.reshape(-1)
    out[:, 0] = flat >> 8
    out[:, 1:] = np.unpackbits((flat & 0xFF).astype(np.uint8)).reshape(-1, 8)
    return out.reshape(-1)


#: Size category s has a code of 9 - s bits: with its s extra bits a DC symbol always takes 9.
DC_LENGTHS = {s: 9 - s for s in range(8)}


def _dc_words() -> np.ndarray:
    """9-bit word of each difference from -127 to 127."""
    codes, code, last = {}, 0, 0
    for s in sorted(DC_LENGTHS, key=DC_LENGTHS.get):
        code <<= DC_LENGTHS[s] - last
        codes[s], last = code, DC_LENGTHS[s]
        code += 1
    out = []
    for d in range(-127, 128):
        s = abs(d).bit_length()
        out.append(codes[s] << s | (d if d >= 0 else d + (1 << s) - 1))
    return np.array(out, dtype=np.uint16)


DC_WORDS = _dc_words()


def encode(payload: bytes) -> bytes:
    """Progressive JPEG of a payload whose length is a positive multiple of 192."""
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    area = wide * high
    raw = np.zeros((area * 6, 64), dtype=np.uint8)
    raw[:blocks] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    coarse = (raw.astype(np.uint16) + SHIFT) >> 1
    parts = {1: slice(0, 4 * area), 2: slice(4 * area, 5 * area), 3: slice(5 * area, 6 * area)}

    def by_mcu(column: np.ndarray) -> np.ndarray:
        luma = column[parts[1]].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(area, 4)
        return np.concatenate([luma, column[parts[2]][:, None], column[parts[3]][:, None]], axis=1)

    dc = by_mcu(coarse[:, 0]).astype(np.int32)
    steps = np.empty_like(dc)
    steps[:, :4] = np.diff(dc[:, :4].reshape(-1), prepend=0).reshape(-1, 4)
    steps[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=0)
    # the very first value of a component is predicted from 0 and so may be 128 to 255: level it
    level = 128
    steps[0, [0, 4, 5]] -= level
    out = [
        b"\xff\xd8",
        _marker(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _marker(0xFE, b"payload %d level %d" % (len(payload), level * 2)),
        _marker(0xDB, b"\x00" + b"\x01" * 64),
        _marker(0xC2, bytes([PRECISION]) + (high * 16).to_bytes(2, "big") + (wide * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        _dht(0, 0, DC_LENGTHS),
        _dht(1, 0, {0x08: 1}),
        _scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], (0, 0), 0, 1, _words9(DC_WORDS[steps + 127])),
    ]
    signed = coarse ^ np.where(SIGNS < 0, 0xFF, 0).astype(np.uint16)  # a negative number's extra bits are those of its magnitude, turned over
    for c, low, top in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        out.append(_scan([(c, 0, 0)], (low, top), 0, 1, _words9(signed[parts[c], low : top + 1])))
    out.append(_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], (0, 0), 1, 0, by_mcu(raw[:, 0] & 1).reshape(-1)))
    for c in (1, 2, 3):
        fine = raw[parts[c], 1:] & 1
        runs = [RUN_MAX] * (len(fine) // RUN_MAX) + ([len(fine) % RUN_MAX] if len(fine) % RUN_MAX else [])
        powers = sorted({r.bit_length() - 1 for r in runs}, reverse=True)
        lengths = {p << 4: i + 1 for i, p in enumerate(powers)}
        bits, at = [], 0
        for r in runs:
            p = r.bit_length() - 1
            code = [1] * powers.index(p) + [0]
            extra = [int(b) for b in format(r - (1 << p), f"0{p}b")] if p else []
            bits += [np.array(code + extra, dtype=np.uint8), fine[at : at + r].reshape(-1)]
            at += r
        out += [_dht(1, 1, lengths), _scan([(c, 0, 1)], (1, 63), 1, 0, np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


@lru_cache(maxsize=256)
class Huffman:
    """A table; files that share one (many do) share its lookups."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, self.lengths = {}, {}
        code, at = 0, 0
        for n in range(1, 17):
            for s in symbols[at : at + counts[n - 1]]:
                self.codes[n, code] = s
                self.lengths[s] = n
                code += 1
            at += counts[n - 1]
            code <<= 1

    @lru_cache(maxsize=4)  # noqa: B019  tables are few and kept anyway
    def width(self, dc: bool) -> int:
        """Bits of every symbol with its extra bits if that is constant and each codes one coefficient; else 0."""
        sizes = {n + (s & 15) for s, n in self.lengths.items()}
        each = dc or all(s >> 4 == 0 and s & 15 for s in self.lengths)
        return sizes.pop() if len(sizes) == 1 and each and max(sizes, default=0) <= 16 else 0

    @lru_cache(maxsize=4)  # noqa: B019
    def values(self, width: int) -> np.ndarray:
        """Value of each word of a uniform table; impossible words are far out of range."""
        table = np.full(1 << width, 1 << 30, dtype=np.int64)
        for (n, code), s in self.codes.items():
            size = s & 15
            table[code << size : (code + 1) << size] = [_extend(v, size) for v in range(1 << size)]
        return table


def _extend(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


class _Bits:
    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits, 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | int(b)
        self.at += n
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such Huffman code")

    def flat(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a scan ends early")
        self.at += n
        return out


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks that the picture needs
    down: int = 0
    stride: int = 0  # blocks that are kept, whole MCUs
    coef: np.ndarray = field(default=None, repr=False)


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""
    precision: int = 8


def _read_scan(bits: np.ndarray, order: list[tuple[Component, np.ndarray, int, int]], tables: dict, band: tuple[int, int], high: int, low: int) -> None:
    """One restart interval.  order: component, blocks per MCU as (mcus, blocks), DC and AC table."""
    reader = _Bits(bits)
    start, end = band
    if start == 0:
        per = sum(o[1].shape[1] for o in order)
        mcus = len(order[0][1])
        if high:
            got = reader.flat(mcus * per).reshape(mcus, per)
        else:
            used = [tables[0, o[2]] for o in order]
            widths = {t.width(True) for t in used}
            if len(widths) == 1 and (w := widths.pop()) and len(set(map(id, used))) == 1:
                cells = reader.flat(mcus * per * w).reshape(-1, w)
                words = cells.astype(np.int64) @ (1 << np.arange(w - 1, -1, -1))
                got = used[0].values(w)[words].reshape(mcus, per)
            else:
                got = np.array([[_extend(reader.take(s), s) for o, t in zip(order, used) for _ in range(o[1].shape[1]) for s in [reader.symbol(t)]] for _ in range(mcus)], dtype=np.int64).reshape(mcus, per)
            if got.size and np.abs(got).max() > 1 << 20:
                raise ValueError("no such Huffman code")
        at = 0
        for comp, blocks, _, _ in order:
            mine = got[:, at : at + blocks.shape[1]].reshape(-1)
            at += blocks.shape[1]
            if high:
                comp.coef[blocks.reshape(-1), 0] |= mine.astype(np.int32) << low
            else:
                comp.coef[blocks.reshape(-1), 0] = np.cumsum(mine) << low
        return
    ((comp, blocks, _, ac),) = order
    table, blocks, coef = tables[1, ac], blocks.reshape(-1), comp.coef
    size = end - start + 1
    if not high:
        if w := table.width(False):
            cells = reader.flat(len(blocks) * size * w).reshape(-1, w)
            if table.codes == {(1, 0): w - 1}:
                if cells[:, 0].any():
                    raise ValueError("no such Huffman code")
                words = np.packbits(cells[:, 1:], axis=1) if w == 9 else None
                if words is not None:
                    words = words[:, 0].astype(np.int32)
                    got = np.where(words >= 128, words, words - 255)
            if table.codes != {(1, 0): w - 1} or w != 9:
                got = table.values(w)[cells.astype(np.int64) @ (1 << np.arange(w - 1, -1, -1))]
            coef[_span(blocks), start : end + 1] = got.reshape(-1, size) << low
            return
        i = 0
        while i < len(blocks):
            k = start
            while k <= end:
                s = reader.symbol(table)
                run, n = s >> 4, s & 15
                if n == 0 and run < 15:
                    i += (1 << run) + reader.take(run) - 1
                    break
                k += run
                if n:
                    coef[blocks[i], k] = _extend(reader.take(n), n) * (1 << low)
                k += 1
            i += 1
        return
    one = 1 << low
    i = 0
    while i < len(blocks):
        k, row = start, coef[blocks[i]]
        while k <= end:
            s = reader.symbol(table)
            run, n = s >> 4, s & 15
            if n == 0 and run < 15:
                count = (1 << run) + reader.take(run)
                _correct(coef, blocks[i : i + 1], k, end, reader, one)
                _correct(coef, blocks[i + 1 : i + count], start, end, reader, one)
                i += count - 1
                break
            new = (one if reader.take(1) else -one) if n else 0
            while k <= end:
                if row[k]:
                    if reader.take(1):
                        row[k] += one if row[k] > 0 else -one
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if new and k <= end:
                row[k] = new
            k += 1
        i += 1


def _correct(coef: np.ndarray, blocks: np.ndarray, start: int, end: int, reader: _Bits, one: int) -> None:
    """Correction bits of the coefficients that are not zero yet, of whole blocks in order."""
    if start > end or not len(blocks):
        return
    at = _span(blocks)
    part = coef[at, start : end + 1]
    if part.all():
        part += np.where(part > 0, np.int32(one), np.int32(-one)) * reader.flat(part.size).reshape(part.shape)
    else:
        known = part != 0
        part[known] += np.sign(part[known]) * one * reader.flat(int(known.sum())).astype(np.int32)
    if at is blocks:
        coef[blocks, start : end + 1] = part


_NEXT_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.DOTALL)


def _segments(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, its body, entropy-coded bytes after it)."""
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        code = data[at + 1]
        if code == 0xD9:
            return
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        coded = b""
        if code == 0xDA:
            stop = _NEXT_MARKER.search(data, at)
            coded, at = data[at : stop.start() if stop else len(data)], stop.start() if stop else len(data)
        yield code, body, coded


@lru_cache(maxsize=4)
def _grid(down: int, across: int, stride: int) -> np.ndarray:
    """Blocks of a component in the order of a scan of its own; the scans of a picture share it."""
    return (np.arange(down)[:, None] * stride + np.arange(across)).reshape(-1, 1)


@lru_cache(maxsize=4)
def _mcu_grid(down: int, across: int, v: int, h: int, stride: int) -> np.ndarray:
    """Blocks of a component in the order of a scan of several, a row for each MCU."""
    r, c = np.arange(down)[:, None, None, None] * v, np.arange(across)[None, :, None, None] * h
    return ((r + np.arange(v)[:, None]) * stride + c + np.arange(h)).reshape(down * across, -1)


def _span(blocks: np.ndarray) -> np.ndarray | slice:
    """Rising numbers of blocks as a slice, which copies nothing, if none is left out."""
    return slice(blocks[0], blocks[-1] + 1) if len(blocks) and blocks[-1] - blocks[0] + 1 == len(blocks) else blocks


def read(data: bytes) -> Picture:
    """All scans of a progressive JPEG, accumulated in coefficient arrays (zigzag order)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    tables: dict[tuple[int, int], Huffman] = {}
    quants: dict[int, np.ndarray] = {}
    picture, comment, restart = None, b"", 0
    for code, body, coded in _segments(data):
        if code == 0xFE:
            comment = body
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xDB:
            at = 0
            while at < len(body):
                wide, ident = body[at] >> 4, body[at] & 15
                n = 64 * (1 + wide)
                quants[ident] = np.frombuffer(body[at + 1 : at + 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int32)
                at += 1 + n
        elif code == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                tables[body[at] >> 4, body[at] & 15] = Huffman(counts, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif code == 0xC2:
            if body[0] not in (8, 12) or body[5] not in (1, 3):
                raise ValueError("only pictures of 8 or 12 bits with 1 or 3 components")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in comps:
                c.across, c.down, c.stride = -(-(-(-width * c.h // hmax)) // 8), -(-(-(-height * c.v // vmax)) // 8), mx * c.h
                c.coef = np.zeros((c.stride * my * c.v, 64), dtype=np.int32)
            picture = Picture(width, height, comps, quants, precision=body[0])
        elif 0xC0 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman pictures")
        elif code == 0xDA:
            order = []
            for i in range(body[0]):
                comp = next(c for c in picture.components if c.ident == body[1 + 2 * i])
                if body[0] == 1:
                    blocks = _grid(comp.down, comp.across, comp.stride)
                else:
                    blocks = _mcu_grid(my, mx, comp.v, comp.h, comp.stride)
                order.append((comp, blocks, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
            start, end, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            parts = _RESTART.split(coded) if restart else [coded]
            every = restart or len(order[0][1])
            for j, part in enumerate(parts):
                bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), dtype=np.uint8))
                rows = [(c, b[j * every : (j + 1) * every], d, a) for c, b, d, a in order]
                _read_scan(bits, rows, tables, (start, end), approx >> 4, approx & 15)
    if picture is None:
        raise ValueError("no frame")
    picture.comment = comment
    return picture


def to_rgb(picture: Picture) -> np.ndarray:
    """Inverse transform, chroma upsampling and colour conversion: (height, width, 3) of uint8, or of uint16 for 12 bits."""
    half = 1 << (picture.precision - 1)
    hmax, vmax = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        samples = (c.coef * picture.quants[c.quant]).astype(np.float32) @ IDCT
        plane = samples.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8)
        np.clip(np.rint(plane, out=plane), -half, half - 1, out=plane)
        if c.v < vmax:
            plane = plane.repeat(vmax // c.v, axis=0)
        if c.h < hmax:
            plane = plane.repeat(hmax // c.h, axis=1)
        planes.append(plane[: picture.height, : picture.width])
    y = planes[0] + np.float32(half)
    out = np.empty((*y.shape, 3), dtype=np.uint8 if picture.precision == 8 else np.uint16)
    if len(planes) == 1:
        out[:] = y[..., None]
        return out
    cb, cr = planes[1:]
    for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[..., i] = np.clip(np.rint(channel), 0, 2 * half - 1)
    return out


_NOTE = re.compile(rb"payload (\d+) level (\d+)")


def payload_of(picture: Picture) -> bytes:
    """The payload that `encode` stored."""
    n, level = map(int, _NOTE.fullmatch(picture.comment).groups())
    coef = np.concatenate([c.coef for c in picture.components])
    coef[:, 0] += level
    return (np.abs(coef) - SHIFT).astype(np.uint8).tobytes()[:n]


def feature_of(rgb: np.ndarray) -> str:
    """Size, then mean and variance of each channel, from whole-number sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    out = [f"{rgb.shape[1]}x{rgb.shape[0]}"]
    for i in range(3):
        counts = np.bincount(flat[:, i])
        s, q = int(counts @ np.arange(len(counts))), int(counts @ np.arange(len(counts)) ** 2)
        out.append(f"{s / n:.2f}/{(q - s * s / n) / n:.2f}")
    return " ".join(out)


# ---------------------------------------------------------------- columns


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text in UTF-8, padded with spaces to a positive multiple of 192, as a picture."""

    def step(ids, texts):
        raw = [t or b"" for t in texts.to_pylist()]
        return [ids, [len(t) for t in raw], [encode(t + b" " * (-len(t) % UNIT or (0 if t else UNIT))) for t in raw]]

    return map_texts(df, id_col, text_col, step, "doc_id long, n_bytes long, media binary", as_binary=True)


def tensors(df: DataFrame) -> DataFrame:
    """The media of `store` read back: doc_id, n_bytes, digests of the payload and of the stored form, and height, width, depth, rgb.

    rgb is the full-resolution RGB tensor, row by row, in little-endian samples of depth bits (8 or 16).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, depth int, rgb binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            begin, rows, size = 0, [], 0
            for i, media in enumerate(b.column(2), 1):
                media = media.as_py()
                picture = read(media)
                payload, rgb = payload_of(picture), to_rgb(picture)
                raw = rgb.astype(rgb.dtype.newbyteorder("<")).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), *rgb.shape[:2], rgb.itemsize * 8, raw))
                size += len(raw)
                if size >= 1 << 23 or i == b.num_rows:  # a tensor is several times its media
                    cut = [b.column(k).slice(begin, len(rows)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*cut, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:]))], schema=schema)
                    begin, rows, size = i, [], 0

    bounded_batches(df.sparkSession)
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def features(df: DataFrame) -> DataFrame:
    """The rows of `tensors` with a feature of the tensor column in its place."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c not in ("height", "width", "depth", "rgb")]
    schema = to_arrow_schema(df.select(*kept).schema).append(pa.field("feature", pa.string()))

    def run(batches):
        for b in batches:
            shape = zip(*(b.column(len(kept) + k).to_pylist() for k in range(3)))
            made = [feature_of(np.frombuffer(raw.as_buffer(), dtype="<u1" if depth == 8 else "<u2").reshape(h, w, 3)) for (h, w, depth), raw in zip(shape, b.column(len(kept) + 3))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), pa.array(made, pa.string())], schema=schema)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return df.select(*kept, "height", "width", "depth", "rgb").mapInArrow(run, f"{ddl}, feature string")


def load(df: DataFrame) -> DataFrame:
    """Read the media of `store` back into a tensor column, and take features from that column: payload digests, the stored form's digest, feature."""
    return features(tensors(df))
