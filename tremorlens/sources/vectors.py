"""Shapefile layers: geometry and attributes from the bytes of .shp and .dbf files, checks, and points inside polygons."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import from_utm37, utm37
from ..operators.groups import materialize

RINGS = "array<array<struct<x:double,y:double>>>"
# Shape types of the format (the Z and M forms add 10 and 20), and its file code.
POINT, LINE, POLYGON, MULTIPOINT, FILE_CODE = 1, 3, 5, 8, 9994


def layer_header(content: Column) -> Column:
    """shape type and bounds from the first 100 bytes of a .shp file, for layers too large to be read whole."""
    real = lambda at: F.substring(content, at + 1, 8)

    @F.pandas_udf("type int, x0 double, y0 double, x1 double, y1 double")
    def parse(heads: pd.Series) -> pd.DataFrame:
        rows = [(struct.unpack_from("<i", h, 0)[0], *struct.unpack_from("<4d", h, 4)) if h is not None and len(h) == 36 else (None,) * 5 for h in heads]
        return pd.DataFrame(rows, columns=["type", "x0", "y0", "x1", "y1"])

    return parse(F.concat(F.substring(content, 33, 4), *[real(at) for at in (36, 44, 52, 60)]))


def _shapes(content: bytes) -> Iterator[tuple[int, int, list]]:
    if struct.unpack_from(">i", content, 0)[0] != FILE_CODE:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">2i", content, at)
        body, at = at + 8, at + 8 + 2 * words
        kind = struct.unpack_from("<i", content, body)[0] % 10
        if kind == POINT:
            parts = [[struct.unpack_from("<2d", content, body + 4)]]
        elif kind in (LINE, POLYGON):
            n, m = struct.unpack_from("<2i", content, body + 36)
            starts = [*struct.unpack_from(f"<{n}i", content, body + 44), m]
            flat = struct.unpack_from(f"<{2 * m}d", content, body + 44 + 4 * n)
            points = list(zip(flat[::2], flat[1::2]))
            parts = [points[a:b] for a, b in zip(starts, starts[1:])]
        elif kind == MULTIPOINT:
            m = struct.unpack_from("<i", content, body + 36)[0]
            flat = struct.unpack_from(f"<{2 * m}d", content, body + 40)
            parts = [[p] for p in zip(flat[::2], flat[1::2])]
        else:
            parts = []
        yield number, kind, parts


def read_shapes(files: DataFrame) -> DataFrame:
    """path, feature (from 1), type, rings (parts of points; none for an empty shape) of .shp files; a file is a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = [(path, n, kind, [[{"x": x, "y": y} for x, y in part] for part in parts]) for n, kind, parts in _shapes(content)]
                yield pd.DataFrame(rows, columns=["path", "feature", "type", "rings"])

    return files.select("path", "content").mapInPandas(run, f"path string, feature long, type int, rings {RINGS}")


def read_attributes(files: DataFrame) -> DataFrame:
    """path, feature (from 1), fields (name to text; blank is null) of .dbf files; deleted rows keep their number and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                n, head, wide = struct.unpack_from("<IHH", content, 4)
                fields, at = [], 32
                while content[at] != 0x0D:
                    fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
                    at += 32
                rows = []
                for k in range(n):
                    row = content[head + k * wide : head + (k + 1) * wide]
                    if row[:1] == b"*":
                        continue
                    own, at = {}, 1
                    for name, size in fields:
                        own[name] = row[at : at + size].decode("utf-8", "replace").strip(" \0") or None
                        at += size
                    rows.append((path, k + 1, own))
                yield pd.DataFrame(rows, columns=["path", "feature", "fields"])

    return files.select("path", "content").mapInPandas(run, "path string, feature long, fields map<string,string>")


def geometry_problems(shapes: DataFrame) -> DataFrame:
    """path, features, empty, invalid (a ring open, of fewer than four points or not finite, or without area), and
    duplicates after the first of equal geometries."""
    ring = lambda r: (F.size(r) >= 4) & r[0].eqNullSafe(F.element_at(r, -1)) & (F.abs(_area(r)) > 0) & F.forall(r, lambda p: F.abs(p["x"]) < float("inf")) & F.forall(r, lambda p: F.abs(p["y"]) < float("inf"))
    empty = F.size(F.flatten("rings")) <= 0
    bad = (F.col("type") == POLYGON) & ~empty & F.exists("rings", lambda r: ~F.coalesce(ring(r), F.lit(False)))
    marked = shapes.select("path", empty.alias("empty"), bad.alias("bad"), F.sha2(F.to_json(F.struct("type", "rings")), 256).alias("mark"))
    each = marked.groupBy("path", "mark").agg(F.count(F.lit(1)).alias("n"), F.count_if("empty").alias("e"), F.count_if("bad").alias("b"))
    return each.groupBy("path").agg(F.sum("n").alias("features"), F.sum("e").alias("empty"), F.sum("b").alias("invalid"), F.sum(F.col("n") - 1).alias("duplicates"))


def _area(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    turns = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(turns, F.lit(0.0), lambda s, t: s + t)


def with_plane_interior_point(df: DataFrame, rings: str, name: str) -> DataFrame:
    """df with `name`: a point inside each polygon given in degrees (x: longitude, y: latitude), found as by interior_point
    in the plane of zone 37 north, in degrees; null without one. Each step is a column of its own, so that none is repeated,
    and the result is written, as a filter on it would be pushed through the steps and repeat them all."""

    def flat(p: Column) -> Column:
        east, north = utm37(p["y"], p["x"])
        return F.struct(east.alias("x"), north.alias("y"))

    out = df.withColumn("_flat", F.transform(rings, lambda r: F.transform(r, flat)))
    out = out.withColumn("_ys", F.array_sort(F.array_distinct(F.transform(F.flatten("_flat"), lambda p: p["y"]))))
    out = out.withColumn("_middle", (F.array_min("_ys") + F.array_max("_ys")) / 2)
    below, above = F.array_max(F.filter("_ys", lambda y: y <= F.col("_middle"))), F.array_min(F.filter("_ys", lambda y: y > F.col("_middle")))
    out = out.withColumn("_height", (below + above) / 2)
    following = lambda r: F.concat(F.slice(r, 2, 1 << 30), F.slice(r, 1, 1))
    edges = F.flatten(F.transform("_flat", lambda r: F.zip_with(r, following(r), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    out = out.withColumn("_cut", F.filter(edges, lambda e: (e["a"]["y"] > F.col("_height")) != (e["b"]["y"] > F.col("_height"))))
    across = lambda e: e["a"]["x"] + (F.col("_height") - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
    out = out.withColumn("_at", F.array_sort(F.transform("_cut", across)))
    stretch = lambda k: F.struct((F.get("_at", 2 * k + 1) - F.get("_at", 2 * k)).alias("wide"), ((F.get("_at", 2 * k + 1) + F.get("_at", 2 * k)) / 2).alias("x"))
    inner = F.when(F.size("_at") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("_at") / 2).cast("int") - 1), stretch))
    out = out.withColumn("_best", F.array_max(F.filter(inner, lambda p: p["wide"] > 0)))
    out = out.withColumns({"_east": F.col("_best.x"), "_north": F.col("_height")})
    la, lo = from_utm37(F.col("_east"), F.col("_north"))
    out = out.withColumns({"_la": la, "_lo": lo}).withColumn(name, F.when(F.col("_east").isNotNull(), F.struct(F.col("_lo").alias("x"), F.col("_la").alias("y"))))
    return materialize(out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name))


def interior_point(rings: Column) -> Column:
    """struct(x, y) inside a polygon (holes by the even-odd rule): the middle of the widest stretch inside it on a line
    half-way up, or between the corners next to that height if one lies on it. Null without such a stretch."""
    ys = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    below, above = F.array_max(F.filter(ys, lambda y: y <= middle)), F.array_min(F.filter(ys, lambda y: y > middle))
    height = (below + above) / 2
    edges = F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, 1 << 30), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    cut = F.filter(edges, lambda e: (e["a"]["y"] > height) != (e["b"]["y"] > height))
    at = F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (height - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    pairs = F.filter(F.transform(at, lambda x, k: F.when((k % 2 == 0) & (k + 1 < F.size(at)), F.struct((F.get(at, k + 1) - x).alias("wide"), ((F.get(at, k + 1) + x) / 2).alias("x"))).otherwise(F.lit(None))), lambda p: p.isNotNull() & (p["wide"] > 0))
    return F.when(F.size(pairs) > 0, F.struct(F.array_max(pairs)["x"].alias("x"), height.alias("y")))
