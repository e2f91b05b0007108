"""Nearest neighbours at any distance: a hierarchy of occupied cells, searched by lower and upper bounds.

Points lie on the unit sphere, so neither the poles nor the antimeridian are special. A cube around the searched side is
cut into 4 x 4 x 4 cells, and cells with more than a few points again; only occupied cells exist. A point that looks for
its nearest one keeps a frontier of cells: none of its points is nearer than the cell's near side, and one of them is no
farther than its far corner. In each round a point opens its few nearest cells; cells that lie wholly beyond the least
upper bound go. What isn't opened yet waits for a later round, so the few only bound a round's work, not the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, haversine
from .groups import materialize

AXES = ("x", "y", "z")
#: Binary digits of a coordinate in a cell's place per level (4 cells along an axis), and the deepest level: at 2 ** -27
#: of the earth's width cells are centimetres wide.
STEP, DEEPEST = 2, 13
#: Points of a cell that isn't cut any more, and cells that a point opens in a round.
LEAF, OPENED = 32, 8
#: Bounds give way by so much for what doubles round (a tenth of a millimetre).
SLACK = 1e-11


def _on_sphere(la: Column, lo: Column) -> dict[str, Column]:
    phi, lam = F.radians(la), F.radians(lo)
    return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}


def _positions(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct places: la, lo, x, y, z."""
    places = df.select(F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).distinct()
    return places.withColumns(_on_sphere(F.col("la"), F.col("lo")))


class CellTree:
    """nodes: level, cx, cy, cz of each occupied cell, leaf (not cut further); points: the level and cell of each point's leaf."""

    def __init__(self, places: DataFrame, leaf: int = LEAF):
        places = materialize(places)
        corner = places.agg(*[F.min(a).alias(a) for a in AXES], F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("wide")).first()
        self.empty = corner["wide"] is None
        if self.empty:
            return
        self.corner, self.wide = {a: corner[a] for a in AXES}, max(corner["wide"], 1e-12) * (1 + 1e-9)
        finest = 1 << STEP * DEEPEST
        rest = places.withColumns({f"f{a}": F.floor((F.col(a) - self.corner[a]) / self.wide * finest).cast("int") for a in AXES})
        nodes, points = [], []
        for level in range(1, DEEPEST + 1):
            at = {f"c{a}": F.shiftright(f"f{a}", STEP * (DEEPEST - level)) for a in AXES}
            cells = materialize(rest.groupBy(*[c.alias(n) for n, c in at.items()]).agg((F.count(F.lit(1)) <= leaf).alias("leaf")).withColumns({"level": F.lit(level), "leaf": F.col("leaf") | F.lit(level == DEEPEST)}))
            nodes.append(cells)
            placed = materialize(rest.withColumns(at).join(cells, list(at)))
            points.append(placed.where("leaf").select("level", *at, "la", "lo"))
            rest = placed.where(~F.col("leaf")).drop(*at, "leaf", "level")
            if rest.isEmpty():
                break
        self.nodes, self.points = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, points)

    def bounds(self, level: Column, prefix: str) -> tuple[Column, Column]:
        """Squares of the least and the largest distance from (x, y, z) to a point of a cell."""
        side = F.lit(self.wide) / F.pow(F.lit(2.0), STEP * level)
        low = {a: self.corner[a] + F.col(f"{prefix}{a}") * side for a in AXES}
        near = sum(F.pow(F.greatest(low[a] - F.col(a), F.col(a) - low[a] - side, F.lit(0.0)), 2) for a in AXES)
        far = sum(F.pow(F.greatest(F.abs(F.col(a) - low[a]), F.abs(F.col(a) - low[a] - side)), 2) for a in AXES)
        return F.greatest(F.sqrt(near) - SLACK, F.lit(0.0)), F.sqrt(far) + SLACK


def nearest_by_bounds(left: DataFrame, right: DataFrame, lat: str, lon: str, leaf: int = LEAF, opened: int = OPENED) -> DataFrame:
    """la, lo of each distinct valid place of left, distance to the nearest place of right. No rows if right has none.

    In a round a place meets at most `opened` cells with 64 parts or `leaf` points each (more only where points are
    nearer to each other than centimetres). Rounds go on until no cell can hold a nearer point.
    """
    tree = CellTree(_positions(right, lat, lon), leaf)
    places = _positions(left, lat, lon)
    if tree.empty:
        return places.select("la", "lo", F.lit(0.0).alias("distance")).limit(0)
    place = ["la", "lo", *AXES]
    cell = ["level", *[f"c{a}" for a in AXES]]
    root = places.select(*place, F.lit(0).alias("level"), *[F.lit(0).alias(f"c{a}") for a in AXES], F.lit(False).alias("leaf"), F.lit(0.0).alias("near"), F.lit(4.0).alias("most"))
    frontier = materialize(root)
    up = {f"p{a}": F.shiftright(f"c{a}", STEP) for a in AXES}
    parts = tree.nodes.withColumns(up).withColumn("above", F.col("level") - 1)
    first = Window.partitionBy("la", "lo").orderBy("near", "level", *[f"c{a}" for a in AXES])
    found = None
    while True:
        ranked = materialize(frontier.withColumn("turn", F.row_number().over(first)))
        now = ranked.where(F.col("turn") <= opened)
        waiting = ranked.where(F.col("turn") > opened).select(*place, *cell, "leaf", "near", "most")
        outer = now.where(~F.col("leaf")).select(*place, "most", F.col("level").alias("above"), *[F.col(f"c{a}").alias(f"p{a}") for a in AXES])
        near, far = tree.bounds(F.col("level"), "c")
        inner = outer.join(parts, ["above", "px", "py", "pz"]).select(*place, *cell, "leaf", near.alias("near"), F.least("most", far).alias("most"))
        d = haversine(F.col("la"), F.col("lo"), F.col("b_la"), F.col("b_lo"))
        points = tree.points.withColumnsRenamed({"la": "b_la", "lo": "b_lo"})
        tested = materialize(now.where("leaf").join(points, cell).groupBy(*place).agg(F.min(d).alias("distance")))
        found = tested if found is None else found.unionByName(tested)
        # The chord of a distance is an upper bound like any other.
        chord = tested.select(*place, (2 * F.sin(F.col("distance") / (2 * RADIUS)) + SLACK).alias("most"))
        each = inner.unionByName(waiting).unionByName(chord, allowMissingColumns=True)
        least = F.min("most").over(Window.partitionBy("la", "lo"))
        frontier = materialize(each.withColumn("most", least).where(F.col("level").isNotNull() & (F.col("near") <= F.col("most"))))
        if frontier.isEmpty():
            return found.groupBy("la", "lo").agg(F.min("distance").alias("distance"))
