"""GeoTIFF bands: header, and statistics of each block without a pixel leaving its task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags of the format that are read, sizes of its field types, and compressions that are understood.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SIZE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, DEFLATE = (1,), (8, 32946)


def _tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", content, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", content, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", content, entry)
        if kind not in FIELD:
            continue
        form = f"{order}{n}{FIELD[kind]}"
        place = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
        out[tag] = struct.unpack_from(form, content, place)
    return order, out


def _nodata(tags: dict[int, tuple]) -> float | None:
    return float(tags[NODATA][0].strip(b"\0 ")) if NODATA in tags else None


def raster_header(files: DataFrame) -> DataFrame:
    """path, columns, rows, bands, bits, nodata, pixel size and upper left corner of TIFF files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                _, t = _tags(content)
                size, tie = t.get(PIXEL_SIZE, (None, None)), t.get(TIE_POINT, (None,) * 6)
                rows.append((path, t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0], t.get(BITS, (1,))[0], _nodata(t), size[0], size[1], tie[3], tie[4]))
            yield pd.DataFrame(rows, columns=["path", "columns", "rows", "bands", "bits", "nodata", "dx", "dy", "left", "top"])

    return files.select("path", "content").mapInPandas(run, "path string, columns int, rows int, bands int, bits int, nodata double, dx double, dy double, left double, top double")


def _blocks(content: bytes) -> Iterator[np.ndarray]:
    """First band of each strip or tile, cut to the picture."""
    order, t = _tags(content)
    wide, high, bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    compression, kind = t.get(COMPRESSION, (1,))[0], t.get(FORMAT, (1,))[0]
    if compression not in (*PLAIN, *DEFLATE) or t.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {t.get(PREDICTOR, (1,))[0]} isn't read")
    dtype = np.dtype(f"{order}{'uif'[kind - 1]}{t.get(BITS, (8,))[0] // 8}")
    tiled = TILES in t
    w, h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (wide, min(t.get(ROWS, (high,))[0], high))
    mixed = 1 if t.get(PLANAR, (1,))[0] == 2 else bands
    across = -(-wide // w)
    for k, (at, size) in enumerate(zip(*((t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])))):
        if k >= across * -(-high // h):
            return  # further bands of a file that keeps bands apart
        y, x = k // across * h, k % across * w
        raw = content[at : at + size]
        flat = np.frombuffer(zlib.decompress(raw) if compression in DEFLATE else raw, dtype)
        block = flat[: len(flat) // (w * mixed) * w * mixed].reshape(-1, w, mixed)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        yield block[: min(h, high - y), : min(w, wide - x), 0]


def raster_blocks(files: DataFrame) -> DataFrame:
    """path, block, valid, masked, least, largest, histogram (value to pixels, for 8-bit bands) of the first band's blocks.

    Nodata and numbers that aren't finite are masked. A file is a task, a block of it is held at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                hidden, rows = _nodata(_tags(content)[1]), []
                for k, block in enumerate(_blocks(content)):
                    ok = np.isfinite(block) & (block != hidden if hidden is not None else True)
                    seen = block[ok]
                    counts = np.bincount(seen, minlength=1) if block.dtype == np.uint8 else []
                    rows.append((path, k, len(seen), block.size - len(seen), float(seen.min()) if len(seen) else None, float(seen.max()) if len(seen) else None, {int(v): int(n) for v, n in enumerate(counts) if n}))
                yield pd.DataFrame(rows, columns=["path", "block", "valid", "masked", "least", "largest", "histogram"])

    return files.select("path", "content").mapInPandas(run, "path string, block int, valid long, masked long, least double, largest double, histogram map<int,long>")


def raster_statistics(blocks: DataFrame) -> DataFrame:
    """Per file: valid and masked pixels, least, largest, and the pixels of each value as a map sorted by value."""
    total = blocks.groupBy("path").agg(F.sum("valid").alias("valid"), F.sum("masked").alias("masked"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    counts = blocks.select("path", F.explode("histogram").alias("v", "n")).groupBy("path", "v").agg(F.sum("n").alias("n"))
    maps = counts.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("histogram"))
    return total.join(maps, "path", "left")
