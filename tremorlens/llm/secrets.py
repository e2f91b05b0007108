"""Operator 5: secret scans with recursive decoding.

A worklist holds layers of a text, each with a map of its places to the text itself. Every layer is scanned with
the base patterns, and every encoded stretch in it (URL escapes, Unicode escapes, base64, gzip or zlib under either
and under each other) is decoded to a layer of its own, until nothing new comes out. Layers seen before are not entered again,
so a text that decodes to itself ends too. Finds in a layer are reported at the stretch of the text they came from.
Compressed means gzip (all members) or zlib with its header; raw deflate has no mark to know it by and isn't tried.

The worklist is depth first and holds one layer of each depth: layers are decoded when they are wanted, compressed ones
a piece at a time, and only digests of those seen are kept. So memory goes by the longest text and the longest run of
base64 letters in it or in a layer (a run is decoded whole), not by what a stream unpacks to.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate, chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("assign", "access", "hex")
# The base patterns, in the order of KINDS; letters of the key word in either case (ASCII only).
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
URL_SAFE = str.maketrans("-_", "+/")
#: Two bytes that a zlib stream may begin with: method 8, a window of any size, divisible by 31, no preset dictionary.
HEADERS = [(c, f) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20]
COMPRESSED = re.compile(rb"\x1f\x8b\x08|" + b"|".join(re.escape(bytes(h)) for h in HEADERS), re.DOTALL)
PLAIN_SIGN = re.compile(r"[!#$&-;=?-Z^_a-z~]")


def _escaped_headers() -> str:
    """Headers with a byte or both in URL escapes; without any, only where a run begins and an escape follows soon."""
    some = []
    for pair in HEADERS:
        escaped = [f"(?i:%{b:02X})" for b in pair]
        bare = [re.escape(chr(b)) if PLAIN_SIGN.fullmatch(chr(b)) else None for b in pair]
        some.append(escaped[0] + escaped[1])
        if bare[1]:
            some.append(escaped[0] + bare[1])
        if bare[0]:
            some.append(bare[0] + escaped[1])
        if all(bare):
            some.append(rf"(?<![A-Za-z0-9%]){bare[0]}{bare[1]}(?=[^\s%]{{0,8}}%)")
    return "|".join(some)


ESCAPED = re.compile(rf"(?:%1[Ff]%8[Bb]|x\^|{_escaped_headers()})(?:%[0-9A-Fa-f]{{2}}|[!#$&-;=?-Z_a-z~])*")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: Letters of encoded runs and their line breaks.
ENCODED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.%\\\r\n"
#: A decompressed layer is taken in pieces of so many bytes that overlap.
PIECE, OVERLAP = 1 << 22, 1 << 12

Span = tuple[int, int, int]  # start, end (exclusive), number of the kind


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those too short dropped."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A run is matched whole and from its start, so the least length may stand in the pattern.
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


class Layer:
    """A decoded text; places[k] is where the piece from starts[k] on lies in the text below."""

    def __init__(self, text: str, starts: list[int], places: list[tuple[int, int]]):
        self.text, self.starts, self.places = text, starts, places

    def below(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, max(start, end - 1)) - 1
        first, last = self.places[a], self.places[b]
        # A piece copied letter by letter keeps its offsets, a decoded one counts whole.
        low = first[0] + (start - self.starts[a]) if self._plain(a) else first[0]
        high = last[0] + (end - self.starts[b]) if self._plain(b) else last[1]
        return low, high

    def _plain(self, k: int) -> bool:
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return self.places[k][1] - self.places[k][0] == stop - self.starts[k]


def _unescaped(text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The whole text with the stretches of one escape decoded, mapped letter by letter."""
    parts, starts, places, size, at = [], [], [], 0, 0
    for m in pattern.finditer(text):
        if m.start() > at:
            parts.append(text[at : m.start()])
            starts.append(size)
            places.append((at, m.start()))
            size += m.start() - at
        pieces = decode(m.group())
        if pieces is None:
            pieces = [(m.group(), m.end() - m.start())]
        place = m.start()
        for piece, wide in pieces:
            parts.append(piece)
            starts.append(size)
            places.append((place, place + wide))
            size += len(piece)
            place += wide
        at = m.end()
    if not parts:
        return None
    if at < len(text):
        parts.append(text[at:])
        starts.append(size)
        places.append((at, len(text)))
    return Layer("".join(parts), starts, places)


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes(int(run[k + 1 : k + 3], 16) for k in range(0, len(run), 3))
    out, at = [], 0
    while at < len(raw):
        wide = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 1
        try:
            out.append((raw[at : at + wide].decode(), 3 * wide))
        except UnicodeDecodeError:
            wide = 1
            out.append((run[3 * at : 3 * at + 3], 3))
        at += wide
    return out


def _escape(run: str) -> list[tuple[str, int]]:
    units = [int(run[k + 2 : k + 6], 16) for k in range(0, len(run), 6)]
    out, at = [], 0
    while at < len(units):
        if 0xD800 <= units[at] < 0xDC00 and at + 1 < len(units) and 0xDC00 <= units[at + 1] < 0xE000:
            out.append((chr(0x10000 + (units[at] - 0xD800) * 1024 + units[at + 1] - 0xDC00), 12))
            at += 2
        else:
            out.append((chr(units[at]) if not 0xD800 <= units[at] < 0xE000 else run[6 * at : 6 * at + 6], 6))
            at += 1
    return out


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a gzip (of all its members) or zlib stream holds, a piece at a time, as far as it can be read."""
    engine = zlib.decompressobj(47)
    try:
        for left in chunks:
            while left:
                if engine.eof:
                    if bytes(left[:2]) != b"\x1f\x8b":
                        return
                    engine = zlib.decompressobj(47)
                if piece := engine.decompress(left, PIECE):
                    yield piece
                left = engine.unused_data if engine.eof else engine.unconsumed_tail
    except zlib.error:
        pass


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The innermost stream of a stream, compressed or not."""
    while True:
        head = b""
        while len(head) < 4 and (more := next(chunks, None)) is not None:
            head += more
        if not COMPRESSED.match(head) or _readable(head) is not None:
            return chain([head], chunks)
        used: list[bytes] | None = [head]

        def read(chunks: Iterator[bytes] = chunks, head: bytes = head) -> Iterator[bytes]:
            yield head
            for more in chunks:
                if used is not None:
                    used.append(more)
                yield more

        inner = _inflated(read())
        first = next(inner, None)
        if first is None:
            return chain(used, chunks)
        used = None
        chunks = chain([first], inner)


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of a stream that overlap; a run of encoded letters comes whole, with what stands before it."""
    held: list[bytes] = []
    waits = False  # whether held has more than the overlap
    for chunk in chunks:
        held.append(chunk)
        waits = not chunk.strip(ENCODED)
        if waits:
            continue  # the run goes on
        whole = b"".join(held)
        yield whole
        held = [whole[max(0, len(whole.rstrip(ENCODED)) - OVERLAP) :]]
    if waits:
        yield b"".join(held)


def _readable(raw: bytes) -> str | None:
    text = raw.decode("utf-8", "ignore")
    plain = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if len(text) >= 6 and plain >= 0.95 * len(text) and len(text.encode("utf-8", "replace")) >= 0.95 * len(raw) else None


def _views(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Bytes as text, with the offset of its first letter and the bytes of each: Latin-1 (the patterns are ASCII) and UTF-16."""
    yield raw.decode("latin-1"), 0, 1
    if b"\0" in raw:
        for k in (0, 1):  # the other order is this one at the other offset
            wide = np.frombuffer(raw, "<u2", (len(raw) - k) // 2, k)
            yield np.where(wide < 0x80, wide, 0xFF).astype(np.uint8).tobytes().decode("latin-1"), k, 2


def _decompressed(raw: bytes, start: int) -> Iterator[str]:
    """Texts of a compressed stream at a place of raw, and of those in it."""
    stream = _inflated(iter([memoryview(raw)[start:]]))
    if (first := next(stream, None)) is None:
        return
    for piece in _pieces(_unpacked(chain([first], stream))):
        if (text := _readable(piece)) is not None:
            yield text
        if text is None or not _strict(piece):
            yield from (view for view, _, _ in _views(piece))
            for m in COMPRESSED.finditer(piece):  # files in an archive
                yield from _decompressed(piece, m.start())


def _strict(raw: bytes) -> bool:
    try:
        return CONTROL.search(raw.decode()) is None
    except UnicodeDecodeError:
        return False


Place = Callable[[int, int], tuple[int, int]]


def _opened(letters: str, place: Callable[[int], int], end: int) -> Iterator[tuple[str, Place, bool]]:
    """Texts of a base64 run, their places, and whether it is plain text to the last byte.

    Where the run as a whole is plain text or compressed, a find lies in the whole run. Else the run may hold other
    letters than base64, so all four alignments are tried, and a find lies in the letters that hold it.
    """
    whole = lambda _a, _b: (place(0), end)
    for k in range(4):
        run = letters[k : len(letters) - (len(letters) - k) % 4] if (len(letters) - k) % 4 == 1 else letters[k:]
        raw = base64.b64decode(run + "=" * (-len(run) % 4))
        text = _readable(raw) if k == 0 else None
        strict = text is not None and _strict(raw)
        if text is not None:
            yield text, whole, strict
        if strict:
            return
        unpacked = False
        for m in COMPRESSED.finditer(raw):
            at = place(k + 4 * (m.start() // 3))
            for inner in _decompressed(raw, m.start()):
                unpacked = unpacked or (k == 0 and m.start() == 0 and len(inner) > 0)
                yield inner, (whole if k == 0 and m.start() == 0 else lambda _a, _b, at=at: (at, end)), False
        for view, first, wide in _views(raw) if text is None else list(_views(raw))[1:]:

            def tight(a: int, b: int, k: int = k, first: int = first, wide: int = wide, n: int = len(run)) -> tuple[int, int]:
                low, high = first + a * wide, first + b * wide
                return place(k + 4 * (low // 3)), place(min(k + 4 * -(-high // 3), k + n) - 1) + 1

            yield view, tight, False


def _packed(text: str) -> Iterator[tuple[str, Place]]:
    """Decoded texts and the places of their letters: base64 runs, also over line breaks, and URL-escaped compressed bytes."""
    clean: list[tuple[int, int]] = []
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [(x.start(), x.group()) for x in LETTERS.finditer(text, m.start(), m.end())]
        letters = "".join(x for _, x in lines)
        if len(letters) < 16:
            continue
        firsts = list(accumulate((len(x) for _, x in lines[:-1]), initial=0))

        def place(i: int, firsts: list = firsts, lines: list = lines) -> int:
            k = bisect_right(firsts, i) - 1
            return lines[k][0] + i - firsts[k]

        for decoded, back, strict in _opened(letters.translate(URL_SAFE), place, m.end()):
            yield decoded, back
            if strict:
                clean.append((m.start(), m.end()))
    for m in BASE64.finditer(text):
        k = bisect_right(clean, (m.start(), len(text))) - 1
        if k >= 0 and m.end() <= clean[k][1]:
            continue  # a line of a run that is text as a whole
        letters = m.group().rstrip("=").translate(URL_SAFE)
        yield from ((decoded, back) for decoded, back, _ in _opened(letters, lambda i, s=m.start(): s + i, m.end()))
    for m in ESCAPED.finditer(text) if "%" in text else ():
        for decoded in _decompressed(unquote_to_bytes(m.group()), 0):
            yield decoded, lambda _a, _b, s=m.start(), e=m.end(): (s, e)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans of all layers) of a whole text, each sorted by start, then kind, then end."""
    base = base_spans(text)
    found = set(base)
    seen = {_mark(text, 0, len(text))}  # a layer and the stretch of the text that it came from
    work: list[tuple[list[Place], Iterator[tuple[str, Place]]]] = [([], _decoded(text))]  # the way back of a layer, and what it holds
    while work:
        maps, inner = work[-1]
        if (layer := next(inner, None)) is None:
            work.pop()
            continue
        decoded, back = layer
        maps = [*maps, back]

        def source(start: int, end: int, maps: list = maps) -> tuple[int, int]:
            for way in reversed(maps):
                start, end = way(start, end)
            return start, end

        mark = _mark(decoded, *source(0, len(decoded)))
        if mark not in seen:
            seen.add(mark)
            found.update((*source(start, end), kind) for start, end, kind in base_spans(decoded))
            work.append((maps, _decoded(decoded)))
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _mark(layer: str, start: int, end: int) -> bytes:
    return blake2b(f"{start},{end},".encode() + layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _decoded(layer: str) -> Iterator[tuple[str, Place]]:
    """The layers right under a layer."""
    if "%" in layer and (out := _unescaped(layer, PERCENT, _percent)):
        yield out.text, out.below
    if "\\u" in layer and (out := _unescaped(layer, ESCAPE, _escape)):
        yield out.text, out.below
    yield from _packed(layer)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col and struct secrets (base, spans: arrays of kind, start, end in code points).

    Null and empty texts have none. Repeated rows all come back, alike; an empty table gives an empty result; other
    columns are ignored.
    """

    @F.pandas_udf("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [tuple([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in all_spans(t or "")) for t in texts]
        return pd.DataFrame(rows, columns=["base", "spans"])

    return docs.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{text_col}`")).alias("secrets"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: str):
        return F.concat_ws(",", F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("secrets.base"), 256).alias("base_sha256"), joined("secrets.spans").alias("spans"))
