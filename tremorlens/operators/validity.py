"""Whether polygons are valid: rings that close, don't meet themselves or each other, and holes that lie in their shells.

A shape's edges are rows, dealt to the cells of a grid over its own box with about as many cells as edges, so only edges
that come near each other are compared, however large the shape is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import materialize

#: Bounds of cells across a shape.
FEWEST, MOST = 1, 4096


def _rings(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """_s, _r (from 0), _p (its points without the closing one), closed, and twice the signed area of each ring."""
    each = shapes.select(F.col(key).alias("_s"), F.posexplode(rings).alias("_r", "_q"))
    closed = F.size("_q") > 0
    closed = closed & F.coalesce((F.get("_q", F.lit(0))["x"] == F.element_at("_q", -1)["x"]) & (F.get("_q", F.lit(0))["y"] == F.element_at("_q", -1)["y"]), F.lit(False))
    turns = F.zip_with(F.slice("_q", 1, F.greatest(F.size("_q") - 1, F.lit(0))), F.slice("_q", 2, F.greatest(F.size("_q"), F.lit(1))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return each.withColumns({"closed": closed, "area": F.aggregate(turns, F.lit(0.0), lambda s, t: s + t), "_n": F.size("_q")})


def _edges(rings: DataFrame) -> DataFrame:
    """_s, _r, _e (from 0), _m (edges of the ring), ax, ay, bx, by of the edges of closed rings; edges without length are left out."""
    pairs = F.zip_with(F.slice("_q", 1, F.greatest(F.size("_q") - 1, F.lit(0))), F.slice("_q", 2, F.greatest(F.size("_q"), F.lit(1))), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    long = F.filter(pairs, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    each = rings.where("closed").select("_s", "_r", F.size(long).alias("_m"), F.posexplode(long).alias("_e", "_x"))
    return each.select("_s", "_r", "_e", "_m", "_x.*")


def _in_cells(edges: DataFrame) -> DataFrame:
    """edges once for each cell that they pass, with its place _cx, _cy and the number of cells across _w."""
    box = edges.groupBy("_s").agg(
        F.min(F.least("ax", "bx")).alias("_x0"), F.min(F.least("ay", "by")).alias("_y0"), F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("_side"),
        F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(F.sqrt(F.count(F.lit(1)))))).alias("_w"))
    at = edges.join(box, "_s").withColumn("_c", F.col("_side") / F.col("_w"))
    cell = lambda v, low: F.least(F.greatest(F.floor((v - F.col(low)) / F.col("_c")), F.lit(0)), F.col("_w") - 1)
    at = at.where("_side > 0").withColumn("_cx", F.explode(F.sequence(cell(F.least("ax", "bx"), "_x0"), cell(F.greatest("ax", "bx"), "_x0"))))
    # The stretch of the edge within this column of cells, and a little more for what rounds.
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    inside = lambda k: F.least(F.greatest(F.col("ay"), F.col("by")), F.greatest(F.least("ay", "by"), F.col("ay") + slope * (F.col("_x0") + k * F.col("_c") - F.col("ax"))))
    one, two = F.coalesce(inside(F.col("_cx")), F.col("ay")), F.coalesce(inside(F.col("_cx") + 1), F.col("by"))
    slack = F.col("_c") * 1e-6
    at = at.withColumn("_cy", F.explode(F.sequence(cell(F.least(one, two) - slack, "_y0"), cell(F.greatest(one, two) + slack, "_y0"))))
    return at.drop("_x0", "_y0", "_side", "_c")


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _meetings(edges: DataFrame) -> DataFrame:
    """_s, _r, _r2, kind, x, y of edges that meet and shouldn't, or touch: cross, overlap, or touch (at a point)."""
    cells = materialize(_in_cells(edges))
    names = ["ax", "ay", "bx", "by"]
    other = cells.select("_s", "_cx", "_cy", F.col("_r").alias("_r2"), F.col("_e").alias("_e2"), *[F.col(n).alias(f"{n}2") for n in names])
    near = cells.join(other, ["_s", "_cx", "_cy"]).where((F.col("_r") < F.col("_r2")) | ((F.col("_r") == F.col("_r2")) & (F.col("_e") < F.col("_e2"))))
    a, b, c, d = [(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "by"), ("ax2", "ay2"), ("bx2", "by2"))]
    t = [_turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)]
    cross = (t[0] * t[1] < 0) & (t[2] * t[3] < 0)
    within = lambda p, u, v: p[0].between(F.least(u[0], v[0]), F.greatest(u[0], v[0])) & p[1].between(F.least(u[1], v[1]), F.greatest(u[1], v[1]))
    on = [(t[0] == 0) & within(c, a, b), (t[1] == 0) & within(d, a, b), (t[2] == 0) & within(a, c, d), (t[3] == 0) & within(b, c, d)]
    points = [c, d, a, b]
    touch = reduce(lambda x, y: x | y, on)
    flat = (t[0] == 0) & (t[1] == 0)
    # On one line: how far both reach along it together.
    along = lambda i: F.least(F.greatest(a[i], b[i]), F.greatest(c[i], d[i])) - F.greatest(F.least(a[i], b[i]), F.least(c[i], d[i]))
    overlap = flat & touch & (F.greatest(along(0), along(1)) > 0) & (along(0) >= 0) & (along(1) >= 0)
    kind = F.when(cross, "cross").when(overlap, "overlap").when(touch, "touch")
    first = lambda i: F.coalesce(*[F.when(o, p[i]) for o, p in zip(on, points)])
    met = near.withColumns({"kind": kind, "x": first(0), "y": first(1)}).where("kind is not null")
    following = (F.col("_r") == F.col("_r2")) & ((F.col("_e2") - F.col("_e") == 1) | ((F.col("_e") == 0) & (F.col("_e2") == F.col("_m") - 1)))
    # Neighbours in a ring share a corner; more than that is a spike.
    return met.where(~following | F.col("kind").isin("overlap", "cross")).select("_s", "_r", "_r2", "kind", "x", "y").distinct()


def _holders(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """_s, _r, depth: how many other rings of the shape a ring lies in, by rays from the middle of its longest edge."""
    size = F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)
    middle = F.struct(((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    probes = edges.groupBy("_s", "_r").agg(F.max_by(middle, F.struct(size, F.col("_e"))).alias("p")).select("_s", F.col("_r").alias("_own"), "p.x", "p.y")
    many = probes.groupBy("_s").agg(F.count(F.lit(1)).alias("_k"), F.min("y").alias("_lo"), F.max("y").alias("_hi")).where("_k > 1")
    # Bands of height: a ray meets only the edges of its band.
    band = lambda y: F.least(F.greatest(F.floor((y - F.col("_lo")) * F.col("_k") / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0)), F.col("_k") - 1)
    at = probes.join(many, "_s").withColumn("_band", F.coalesce(band(F.col("y")), F.lit(0)))
    spans = edges.join(many, "_s").where((F.greatest("ay", "by") >= F.col("_lo")) & (F.least("ay", "by") <= F.col("_hi")))
    spans = spans.withColumn("_band", F.explode(F.sequence(F.coalesce(band(F.least("ay", "by")), F.lit(0)), F.coalesce(band(F.greatest("ay", "by")), F.lit(0))))).select("_s", "_band", "_r", "ax", "ay", "bx", "by")
    hit = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)))
    crossed = at.join(spans, ["_s", "_band"]).where((F.col("_r") != F.col("_own")) & hit).groupBy("_s", "_own", "_r").count()
    return crossed.where("count % 2 = 1").groupBy("_s", F.col("_own").alias("_r")).agg(F.count(F.lit(1)).alias("depth"))


def polygon_problems(shapes: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, problem, ring (from 0, the smaller of two), count: what makes a polygon invalid; no rows of valid ones.

    rings: array of rings, each an array of struct(x, y) that ends where it begins; shells clockwise, holes the other
    way, as layers of shapes have them. Problems: not_finite, open_ring, few_points (fewer than four), no_area,
    self_crossing and self_touching (a ring that meets itself, spikes included), rings_cross (or share a stretch),
    interior_cut (two rings touch in two places or more), hole_outside (of any shell), shell_in_shell. Rings that touch
    at one point are valid. Empty shapes have no problem here. Two or more rings that only together cut the interior
    aren't found.
    """
    found = _rings(shapes.where(F.size(rings) > 0), key, rings)
    finite = F.forall("_q", lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    found = materialize(found.withColumn("finite", finite))
    simple = F.array_compact(F.array(
        F.when(~F.col("finite"), "not_finite"), F.when(F.col("finite") & ~F.col("closed"), "open_ring"), F.when(F.col("closed") & (F.col("_n") < 4), "few_points"), F.when(F.col("finite") & F.col("closed") & (F.col("_n") >= 4) & (F.col("area") == 0), "no_area")))
    own = found.select("_s", F.explode(simple).alias("problem"), F.col("_r").alias("ring"), F.lit(1).alias("n"))
    good = found.where("finite and closed and _n >= 4")
    edges = materialize(_edges(good))
    met = materialize(_meetings(edges))
    same = F.col("_r") == F.col("_r2")
    alone = met.where(same).select("_s", F.when(F.col("kind") == "touch", "self_touching").otherwise("self_crossing").alias("problem"), F.col("_r").alias("ring"), F.lit(1).alias("n"))
    between = met.where(~same)
    crossing = between.where("kind <> 'touch'").select("_s", F.lit("rings_cross").alias("problem"), F.col("_r").alias("ring"), F.lit(1).alias("n"))
    clean = between.groupBy("_s", "_r", "_r2").agg(F.count_if(F.col("kind") != "touch").alias("bad"), F.count_distinct(F.when(F.col("kind") == "touch", F.struct("x", "y"))).alias("places"))
    cut = clean.where("bad = 0 and places > 1").select("_s", F.lit("interior_cut").alias("problem"), F.col("_r").alias("ring"), F.lit(1).alias("n"))
    # Where rings cross, which lies in which has no answer.
    crossed = clean.where("bad > 0").select("_s").distinct()
    depth = good.join(crossed, "_s", "left_anti").join(_holders(good, edges), ["_s", "_r"], "left").withColumn("odd", F.coalesce("depth", F.lit(0)) % 2 == 1)
    nested = depth.where(F.col("area") != 0).select("_s", F.when((F.col("area") > 0) & ~F.col("odd"), "hole_outside").when((F.col("area") < 0) & F.col("odd"), "shell_in_shell").alias("problem"), F.col("_r").alias("ring"), F.lit(1).alias("n")).where("problem is not null")
    every = reduce(DataFrame.unionByName, [own, alone, crossing, cut, nested])
    return every.groupBy(F.col("_s").alias(key), "problem", "ring").agg(F.sum("n").alias("count"))
