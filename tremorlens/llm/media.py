"""Operator 7: media columns with progressive JPEG.

A payload of bytes is stored losslessly in the AC coefficients of a 4:2:0 progressive JPEG: byte b is the
coefficient b (from 128 on) or b - 255, the 256 values of magnitude 128 to 255, so every coefficient has the same
Huffman symbol and eight more bits. Scans: DC and its refinement, then for each component two spectral bands
without their last bit and one refinement with it. The reader accumulates the scans into coefficient arrays; the
payload comes from these, and an inverse DCT in numpy, chroma upsampling and colour conversion give a
full-resolution RGB tensor. Scans whose codes all have one length are read in one go, any other progressive scan
symbol by symbol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Payloads are padded with 255 to a positive multiple of this.
UNIT = 576
#: AC coefficients of a block, and blocks of a 4:2:0 unit (four of Y, one each of Cb and Cr).
AC, BLOCKS = 63, 6
#: Spectral bands of the first scans, and the longest run of blocks that one end-of-band symbol covers.
BANDS, RUN = ((1, 5), (6, 63)), 0x7FFF


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, length: int, symbols: list[int]) -> bytes:
    """A Huffman table whose codes all have one length."""
    counts = [len(symbols) if n == length else 0 for n in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *symbols]))


def _scan(components: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0x00)), start, end, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Packed and padded with ones."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes()


def _runs(blocks: int):
    while blocks:
        n = min(blocks, RUN)
        yield n
        blocks -= n


def grid(payload: int) -> tuple[int, int]:
    """Units across and down for so many bytes."""
    units = max(1, -(-payload // (AC * BLOCKS)))
    across = min(4095, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    if down > 4095:
        raise ValueError("payload too large for one JPEG")
    return across, down


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload (its length is in a comment)."""
    across, down = grid(len(payload))
    units = across * down
    values = np.full(units * BLOCKS * AC, 255, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, AC)
    sizes = (4 * units, units, units)
    planes = np.split(values, np.cumsum(sizes)[:-1])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0]) + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_table(0, 0, 1, [0]), _scan([1, 2, 3], 0, 0, 0, 1, _bits(np.zeros(BLOCKS * units, np.uint8)))]
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, _bits(np.zeros(BLOCKS * units, np.uint8))))
    out.append(_table(1, 0, 1, [0x07]))
    for c, plane in enumerate(planes, 1):
        # One zero bit (symbol: no zeros before, seven bits) and the seven high bits of the value's code.
        out += [_scan([c], a, b, 0, 1, (plane[:, a - 1 : b] >> 1).tobytes()) for a, b in BANDS]
    out.append(_table(1, 0, 4, [n << 4 for n in range(15)]))
    for c, plane in enumerate(planes, 1):
        # The last bit of the magnitude, which is b from 128 on and 255 - b below.
        fine, parts, at = np.where(plane < 128, ~plane, plane) & 1, [], 0
        for n in _runs(len(plane)):
            kind = n.bit_length() - 1
            head = [int(x) for x in f"{kind:04b}" + (f"{n - (1 << kind):0{kind}b}" if kind else "")]
            parts += [np.array(head, np.uint8), fine[at : at + n].ravel()]
            at += n
        out.append(_scan([c], 1, 63, 1, 0, _bits(np.concatenate(parts))))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    across: int  # sampling factors
    down: int
    table: int
    wide: int = 0  # blocks, whole units
    high: int = 0
    own_wide: int = 0  # blocks that the image covers (scans of one component)
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""


class _Reader:
    """Bits of one scan, symbol by symbol."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("not a code of this scan's table")

    def value(self, n: int) -> int:
        v = self.bits(n) if n else 0
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def decode(media: bytes) -> Picture:
    """Coefficients (zigzag order, accumulated over all scans) of a progressive JPEG."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, picture, codes, restart = 2, None, {}, 0
    comment, tables = b"", {}
    while at < len(media):
        marker, size = media[at + 1], struct.unpack(">H", media[at + 2 : at + 4])[0] if media[at + 1] != 0xD9 else 0
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xD9:
            break
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                tables[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                k += 1 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts, code, found, p = body[k + 1 : k + 17], 0, {}, k + 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        found[length, code] = body[p]
                        code, p = code + 1, p + 1
                    code <<= 1
                codes[body[k] >> 4, body[k] & 15] = found
                k = p
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            most = max(c.across for c in parts.values()), max(c.down for c in parts.values())
            for c in parts.values():
                c.wide, c.high = -(-width // (8 * most[0])) * c.across, -(-height // (8 * most[1])) * c.down
                c.own_wide, c.own_high = -(-width * c.across // (8 * most[0])), -(-height * c.down // (8 * most[1]))
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
            picture = Picture(width, height, parts, tables)
        elif marker == 0xDA:
            n = body[0]
            chosen = [(picture.components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
            start, end, step = body[1 + 2 * n : 4 + 2 * n]
            stop = at
            while not (media[stop] == 0xFF and media[stop + 1] not in (0, *range(0xD0, 0xD8))):
                stop = media.index(b"\xff", stop + 1)
            _read_scan(chosen, codes, start, end, step >> 4, step & 15, media[at:stop], restart, picture)
            at = stop
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive JPEG")
    picture.comment = comment
    return picture


def _read_scan(chosen, codes, start, end, high, low, raw, restart, picture) -> None:
    plain = not restart and b"\xff\xd0" not in raw
    if plain and _read_even(chosen, codes, start, end, high, low, raw.replace(b"\xff\x00", b"\xff"), picture):
        return
    pieces = [raw]
    if restart:
        pieces, at = [], 0
        for k in range(len(raw) - 1):
            if raw[k] == 0xFF and 0xD0 <= raw[k + 1] < 0xD8:
                pieces.append(raw[at:k])
                at = k + 2
        pieces.append(raw[at:])
    order = _order(chosen, picture)
    step = restart * (len(order) // _units(chosen, picture) if len(chosen) > 1 else 1) or len(order)
    for k, piece in enumerate(pieces):
        _read_slow(chosen, codes, start, end, high, low, piece.replace(b"\xff\x00", b"\xff"), order[k * step : (k + 1) * step])


def _units(chosen, picture) -> int:
    c = next(iter(picture.components.values()))
    return c.wide // c.across * (c.high // c.down)


def _order(chosen, picture) -> list[tuple[int, int]]:
    """(component of the scan, block) in the order of the scan."""
    if len(chosen) == 1:
        c = chosen[0][0]
        return [(0, r * c.wide + x) for r in range(c.own_high) for x in range(c.own_wide)]
    first = chosen[0][0]
    return [(k, (r * c.down + y) * c.wide + x * c.across + z) for r in range(first.high // first.down) for x in range(first.wide // first.across) for k, (c, _) in enumerate(chosen) for y in range(c.down) for z in range(c.across)]


def _read_even(chosen, codes, start, end, high, low, data, picture) -> bool:
    """Scans whose layout is fixed: read at once. False if this is none."""
    if start == 0:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        blocks = sum(c.wide * c.high for c, _ in chosen)
        if not high and any(list(codes[0, t >> 4].items()) != [((1, 0), 0)] for _, t in chosen):
            return False
        if len(bits) < blocks or bits[:blocks].any():
            return False
        return True  # no difference, or no bit to add, in any block
    c, table = chosen[0]
    if (c.own_wide, c.own_high) != (c.wide, c.high):
        return False
    known, band = codes[1, table & 15], c.coefficients[:, start : end + 1]
    if not high:
        if len(known) != 1 or band.any():
            return False
        (length, _), symbol = next(iter(known.items()))
        if length != 1 or symbol >> 4 or not symbol or 8 * len(data) < band.size * (1 + symbol):
            return False
        if symbol == 7:
            code = np.frombuffer(data, np.uint8)[: band.size].astype(np.int16)
        else:
            code = np.unpackbits(np.frombuffer(data, np.uint8))[: band.size * (1 + symbol)].reshape(-1, 1 + symbol).astype(np.int16) @ (1 << np.arange(symbol, -1, -1)).astype(np.int16)
        if (code >> symbol).any():
            return False
        value = np.where(code >> symbol - 1 > 0, code, code - (1 << symbol) + 1)
        band[:] = (value << low).astype(np.int16).reshape(band.shape)
        return True
    if any(length != 4 or symbol & 15 for (length, _), symbol in known.items()) or not band.all():
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    at, block, size = 0, 0, band.shape[1]
    while block < len(band):
        kind = known[4, int(bits[at : at + 4] @ (8, 4, 2, 1))] >> 4
        extra = int("".join(map(str, bits[at + 4 : at + 4 + kind].tolist())) or "0", 2)
        n, at = (1 << kind) + extra, at + 4 + kind
        own = band[block : block + n]
        fine = bits[at : at + n * size].reshape(n, size).astype(np.int16) << low
        own += np.where(own > 0, fine, -fine)
        block, at = block + n, at + n * size
    return True


def _read_slow(chosen, codes, start, end, high, low, data, order) -> None:
    """Any progressive scan, symbol by symbol."""
    r, before, run = _Reader(data), [0] * len(chosen), 0
    for k, block in order:
        c, table = chosen[k]
        co = c.coefficients[block]
        if start == 0:
            if high:
                co[0] |= r.bits(1) << low
            else:
                before[k] += r.value(r.symbol(codes[0, table >> 4]))
                co[0] = before[k] << low
            continue
        known, at = codes[1, table & 15], start
        if not high:
            if run:
                run -= 1
                continue
            while at <= end:
                symbol = r.symbol(known)
                zeros, n = symbol >> 4, symbol & 15
                if n:
                    at += zeros
                    co[at] = r.value(n) << low
                    at += 1
                elif zeros == 15:
                    at += 16
                else:
                    run = (1 << zeros) + r.bits(zeros) - 1 if zeros else 0
                    break
            continue

        def refine(p: int) -> None:
            if r.bits(1):
                co[p] += (1 << low) if co[p] > 0 else -(1 << low)

        while at <= end and not run:
            symbol = r.symbol(known)
            zeros, n = symbol >> 4, symbol & 15
            new = (1 if r.bits(1) else -1) << low if n else 0
            if not n and zeros < 15:
                run = (1 << zeros) + (r.bits(zeros) if zeros else 0)
                break
            while at <= end:
                if co[at]:
                    refine(at)
                elif zeros:
                    zeros -= 1
                else:
                    co[at] = new
                    at += 1
                    break
                at += 1
        if run:
            for p in range(at, end + 1):
                if co[p]:
                    refine(p)
            run -= 1


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode() stored."""
    values = np.concatenate([c.coefficients[:, 1:] for c in picture.components.values()]).ravel()
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()[: int(picture.comment.split()[1])]


def _basis() -> np.ndarray:
    """64 x 64: samples of each zigzag coefficient."""
    k, n = np.mgrid[:8, :8]
    one = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    return np.einsum("ur,vc->uvrc", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()
#: The basis in whole numbers. Sums of their products are exact in doubles, so equal coefficients give equal samples on any machine.
BASIS_BITS = 14
WHOLE = np.rint(BASIS.astype(np.float64) * (1 << BASIS_BITS))


def rgb(picture: Picture) -> np.ndarray:
    """height x width x 3 tensor of bytes: inverse DCT, chroma upsampling (nearest), YCbCr to RGB."""
    planes = []
    most = max(c.across for c in picture.components.values()), max(c.down for c in picture.components.values())
    for c in picture.components.values():
        spectrum = c.coefficients * picture.tables[c.table]
        samples = np.floor((spectrum.astype(np.float64) @ WHOLE + (1 << BASIS_BITS - 1)) * (1 / (1 << BASIS_BITS)))
        samples = np.clip(samples + 128, 0, 255).astype(np.uint8)
        plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
        plane = plane.repeat(most[1] // c.down, axis=0).repeat(most[0] // c.across, axis=1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    # Colour matrix in 16-bit fixed point, so that equal samples give equal bytes everywhere.
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
    return out


def features(tensor: np.ndarray) -> str:
    """Shape, mean of each channel in hundredths, and the share of samples at either end in thousandths."""
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (tensor.size // 3)
    ends = int(np.count_nonzero(tensor == 0) + np.count_nonzero(tensor == 255)) * 1000 // tensor.size
    return "x".join(map(str, tensor.shape)) + "|" + ",".join(map(str, means.tolist())) + f"|{ends}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media (the JPEG) of each whole text. Null text is empty and gives one unit of padding."""

    @F.pandas_udf("n_bytes long, media binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [padded(t) for t in texts]
        return pd.DataFrame([(n, encode(p)) for n, p in rows], columns=["n_bytes", "media"])

    found = docs.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{text_col}`")).alias("_m"))
    return found.select(id_col, "_m.n_bytes", "_m.media")


def read_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, height, width and rgb (bytes, row by row) of stored JPEGs; null media give nulls."""

    @F.pandas_udf("height int, width int, rgb binary")
    def of(stored: pd.Series) -> pd.DataFrame:
        tensors = [rgb(decode(m)) if m is not None else None for m in stored]
        return pd.DataFrame([(t.shape[0], t.shape[1], t.tobytes()) if t is not None else (None, None, None) for t in tensors], columns=["height", "width", "rgb"])

    return media.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{media_col}`")).alias("_t")).select(id_col, "_t.*")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row, from the JPEG written and read back: id_col, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null text is empty. Repeated rows all come back, alike; an empty table gives an empty result; other columns are
    ignored. A text is stored in one image, which holds up to 6 GB.
    """

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, payload = padded(t)
            media = encode(payload)
            picture = decode(media)
            back = payload_of(picture)
            rows.append((n, len(back), sha256(back).hexdigest(), crc32(back[-32:]), len(media), sha256(media).hexdigest(), features(rgb(picture))))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{text_col}`")).alias("_m")).select(id_col, "_m.*")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
