"""Queries of metrics, shapes, projections, file-order numbers and losses, each with its SQL; registered with those of bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import from_utm37, utm37, valid_coordinates
from ..operators import losses, metrics, validity
from ..sources import tables, vectors
from . import bindings
from . import views as v
from .bindings import query


@query("q57_utm_round_trip", f"WITH {v.SITES} SELECT id, round(la, 8) AS la, round(lo, 8) AS lo FROM sites WHERE {v.OK}")
def q57(spark, sf):
    """Into the plane and back: nothing moves by a billionth of a degree."""
    la, lo = from_utm37(*utm37(F.col("la"), F.col("lo")))
    return v.sites(spark, sf).where(valid_coordinates(F.col("la"), F.col("lo"))).select("id", F.round(la, 8).alias("la"), F.round(lo, 8).alias("lo"))


_SHELL = [(0, 0), (0, 6), (6, 6), (6, 0), (0, 0)]
#: Shapes in small whole numbers: valid, a bow-tie, a hole inside, one outside, one that touches once, one that touches
#: twice, one that crosses, a spike, a shell in a shell, a ring that touches itself.
SHAPES = [
    [_SHELL], [[(0, 0), (6, 6), (6, 0), (0, 6), (0, 0)]], [_SHELL, [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]], [_SHELL, [(7, 1), (8, 1), (8, 3), (7, 3), (7, 1)]],
    [_SHELL, [(0, 3), (2, 2), (2, 4), (0, 3)]], [_SHELL, [(0, 3), (3, 0), (3, 3), (0, 3)]], [_SHELL, [(4, 1), (8, 1), (8, 3), (4, 3), (4, 1)]], [[(0, 0), (0, 6), (3, 6), (3, 9), (3, 6), (6, 6), (6, 0), (0, 0)]],
    [_SHELL, [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]], [[(0, 0), (0, 6), (3, 3), (6, 6), (6, 0), (3, 3), (0, 0)]],
]
_POINTS = ", ".join(f"({k}, {r}, {p}, {x}, {y})" for k, shape in enumerate(SHAPES) for r, ring in enumerate(shape) for p, (x, y) in enumerate(ring))


def _shapes(spark, sf):
    key = F.col("s_suppkey")
    x0, y0 = (key % 100 * 10).cast("double"), F.floor(key / 100).cast("double") * 10
    ring = lambda points: F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in points])
    rings = F.element_at(F.array(*[F.array(*map(ring, shape)) for shape in SHAPES]), (key % len(SHAPES) + 1).cast("int"))
    return v.table(spark, sf, "supplier").select(key.alias("shape"), rings.alias("rings"))


def _turn_sql(p: str, q: str, r: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (x.split() for x in (p, q, r))
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_A, _B, _C, _D = "a.ax a.ay", "a.bx a.yb", "b.ax b.ay", "b.bx b.yb"


def _within_sql(p: str, q: str, r: str) -> str:
    (px, py), (qx, qy), (rx, ry) = (x.split() for x in (p, q, r))
    return f"{px} BETWEEN least({qx}, {rx}) AND greatest({qx}, {rx}) AND {py} BETWEEN least({qy}, {ry}) AND greatest({qy}, {ry})"


_ALONG = [f"least(greatest(a.{p}, a.{q}), greatest(b.{p}, b.{q})) - greatest(least(a.{p}, a.{q}), least(b.{p}, b.{q}))" for p, q in (("ax", "bx"), ("ay", "yb"))]


@query("q58_polygon_problems", f"""WITH t(kind, r, p, x, y) AS (VALUES {_POINTS}),
  pt AS (SELECT s_suppkey AS s, r, p, s_suppkey % 100 * 10 + x AS x, s_suppkey // 100 * 10 + y AS y FROM supplier JOIN t ON kind = s_suppkey % {len(SHAPES)}),
  e AS (SELECT s, r, p AS e, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS yb, count(*) OVER (PARTITION BY s, r) - 1 AS m FROM pt WINDOW w AS (PARTITION BY s, r ORDER BY p) QUALIFY bx IS NOT NULL),
  n AS (SELECT a.s, a.r, b.r AS r2, a.e, b.e AS e2, a.m, {_turn_sql(_A, _B, _C)} AS t0, {_turn_sql(_A, _B, _D)} AS t1, {_turn_sql(_C, _D, _A)} AS t2, {_turn_sql(_C, _D, _B)} AS t3,
    {_within_sql(_C, _A, _B)} AS w0, {_within_sql(_D, _A, _B)} AS w1, {_within_sql(_A, _C, _D)} AS w2, {_within_sql(_B, _C, _D)} AS w3, {_ALONG[0]} AS lx, {_ALONG[1]} AS ly,
    a.ax, a.ay, a.bx, a.yb, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.yb AS dy FROM e a JOIN e b ON a.s = b.s AND (a.r < b.r OR (a.r = b.r AND a.e < b.e))),
  o AS (SELECT *, t0 = 0 AND w0 AS o0, t1 = 0 AND w1 AS o1, t2 = 0 AND w2 AS o2, t3 = 0 AND w3 AS o3 FROM n),
  k AS (SELECT DISTINCT s, r, r2, CASE WHEN t0 * t1 < 0 AND t2 * t3 < 0 THEN 'cross' WHEN t0 = 0 AND t1 = 0 AND (o0 OR o1 OR o2 OR o3) AND greatest(lx, ly) > 0 AND lx >= 0 AND ly >= 0 THEN 'overlap' WHEN o0 OR o1 OR o2 OR o3 THEN 'touch' END AS kind,
    CASE WHEN o0 THEN cx WHEN o1 THEN dx WHEN o2 THEN ax WHEN o3 THEN bx END AS x, CASE WHEN o0 THEN cy WHEN o1 THEN dy WHEN o2 THEN ay WHEN o3 THEN yb END AS y,
    r = r2 AND (e2 - e = 1 OR (e = 0 AND e2 = m - 1)) AS following FROM o),
  met AS (SELECT DISTINCT s, r, r2, kind, x, y FROM k WHERE kind IS NOT NULL AND (NOT following OR kind <> 'touch')),
  ring AS (SELECT s, r, sum(ax * yb - bx * ay) AS area, arg_max((ax + bx) / 2.0, (pow(bx - ax, 2) + pow(yb - ay, 2), e)) AS px, arg_max((ay + yb) / 2.0, (pow(bx - ax, 2) + pow(yb - ay, 2), e)) AS py FROM e GROUP BY 1, 2),
  inside AS (SELECT a.s, a.r, b.r AS r2 FROM ring a JOIN e b ON a.s = b.s AND a.r <> b.r AND (b.ay > py) <> (b.yb > py) AND px < b.ax + (py - b.ay) * (b.bx - b.ax) / nullif(CAST(b.yb - b.ay AS DOUBLE), 0) GROUP BY ALL HAVING count(*) % 2 = 1),
  depth AS (SELECT s, r, count(*) AS d FROM inside GROUP BY 1, 2), pair AS (SELECT s, r, r2, count(*) FILTER (WHERE kind <> 'touch') AS bad, count(DISTINCT (x, y)) FILTER (WHERE kind = 'touch') AS places FROM met WHERE r <> r2 GROUP BY 1, 2, 3),
  p AS (SELECT s, 'no_area' AS problem, r FROM ring WHERE area = 0 UNION ALL SELECT s, CASE WHEN kind = 'touch' THEN 'self_touching' ELSE 'self_crossing' END, r FROM met WHERE r = r2 UNION ALL SELECT s, 'rings_cross', r FROM met WHERE r <> r2 AND kind <> 'touch'
    UNION ALL SELECT s, 'interior_cut', r FROM pair WHERE bad = 0 AND places > 1
    UNION ALL SELECT s, CASE WHEN area > 0 AND coalesce(d, 0) % 2 = 0 THEN 'hole_outside' WHEN area < 0 AND coalesce(d, 0) % 2 = 1 THEN 'shell_in_shell' END, r FROM ring LEFT JOIN depth USING (s, r) WHERE s NOT IN (SELECT s FROM pair WHERE bad > 0))
  SELECT s AS shape, problem, CAST(r AS INTEGER) AS ring, count(*) AS count FROM p WHERE problem IS NOT NULL GROUP BY ALL""")
def q58(spark, sf):
    """Shapes of ten kinds, one for each supplier."""
    return validity.polygon_problems(_shapes(spark, sf), "shape")


@query("q59_plane_interior_points", """SELECT s_suppkey AS shape, CAST(300005 + s_suppkey % 1000 * 100 + 2 * (s_suppkey % 3) AS DOUBLE) AS east, CAST(4100020 + s_suppkey // 10 * 100 AS DOUBLE) AS north FROM supplier""")
def q59(spark, sf):
    """Rectangles of the plane with a hole nearer to the east side, given in degrees; their interior points, back in the plane."""
    key = F.col("s_suppkey")
    e0, n0, wide = 300_000.0 + key % 1000 * 100, 4_100_000.0 + F.floor(key / 10) * 100, 10.0 + 4 * (key % 3)

    def corner(east, north):
        la, lo = from_utm37(east, north)
        return F.struct(lo.alias("x"), la.alias("y"))

    def box(x0, x1, y0, y1):
        return F.array(corner(x0, y0), corner(x0, y1), corner(x1, y1), corner(x1, y0), corner(x0, y0))

    shapes = v.table(spark, sf, "supplier").select(key.alias("shape"), F.array(box(e0, e0 + wide + 8, n0, n0 + 40), box(e0 + wide, e0 + wide + 4, n0 + 10, n0 + 30)).alias("rings"))
    found = vectors.with_plane_interior_point(shapes, "rings", "p").select("shape", F.col("p.x").alias("lo"), F.col("p.y").alias("la"))
    east, north = utm37(F.col("la"), F.col("lo"))
    return found.select("shape", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


@query("q60_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row FROM orders")
def q60(spark, sf):
    """The file holds its rows in order of the key."""
    return tables.with_row_numbers(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"))


_LABELLED = "lab AS (SELECT CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_returnflag = 'R' AS INTEGER) END AS y, l_extendedprice / 1000 AS score, l_quantity / 50 AS share, l_linestatus AS status FROM lineitem)"


def _labelled(spark, sf):
    y = F.when(F.col("l_orderkey") % 13 != 0, (F.col("l_returnflag") == "R").cast("int"))
    return v.table(spark, sf, "lineitem").select(y.alias("y"), (F.col("l_extendedprice") / 1000).alias("score"), (F.col("l_quantity") / 50).alias("share"), F.col("l_linestatus").alias("status"))


_CURVE = """t AS (SELECT score AS threshold, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y <> 1) AS negatives FROM lab WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY 1),
  c AS (SELECT *, CAST(sum(positives) OVER w AS BIGINT) AS true_positives, CAST(sum(negatives) OVER w AS BIGINT) AS false_positives, CAST(sum(positives) OVER () AS BIGINT) AS every FROM t WINDOW w AS (ORDER BY threshold DESC))"""


@query("q61_precision_recall", f"""WITH {_LABELLED}, {_CURVE} SELECT round(threshold, 9) AS threshold, positives, negatives, true_positives, false_positives,
  round(CAST(true_positives AS DOUBLE) / (true_positives + false_positives), 9) AS "precision", round(CAST(true_positives AS DOUBLE) / nullif(every, 0), 9) AS recall FROM c""")
def q61(spark, sf):
    return metrics.precision_recall(_labelled(spark, sf), "y", "score").withColumns({c: F.round(c, 9) for c in ("threshold", "precision", "recall")})


@query("q62_average_precision", f"""WITH {_LABELLED}, {_CURVE} SELECT CAST(sum(positives + negatives) AS BIGINT) AS records, CAST(sum(positives) AS BIGINT) AS positives,
  round(sum(CAST(true_positives AS DOUBLE) / (true_positives + false_positives) * positives) / sum(positives), 9) AS average_precision FROM c""")
def q62(spark, sf):
    return metrics.average_precision(_labelled(spark, sf), "y", "score").withColumn("average_precision", F.round("average_precision", 9))


@query("q63_calibration", f"""WITH {_LABELLED}, t AS (SELECT share AS s, count(*) AS n, count(*) FILTER (WHERE y = 1) AS k FROM lab WHERE y IS NOT NULL AND share IS NOT NULL GROUP BY 1),
  b AS (SELECT *, CAST(least((2 * sum(n) OVER (ORDER BY s) - n) * 10 // (2 * sum(n) OVER ()), 9) AS INTEGER) AS bin FROM t)
  SELECT bin, CAST(sum(n) AS BIGINT) AS records, round(sum(s * n) / sum(n), 9) AS score_mean, round(CAST(sum(k) AS DOUBLE) / sum(n), 9) AS positive_rate, round(abs(sum(s * n) / sum(n) - CAST(sum(k) AS DOUBLE) / sum(n)), 9) AS gap FROM b GROUP BY 1""")
def q63(spark, sf):
    return metrics.calibration(_labelled(spark, sf), "y", "share").withColumns({c: F.round(c, 9) for c in ("score_mean", "positive_rate", "gap")})


_CHANCES = "ch AS (SELECT structure, grade, " + ", ".join(f"CAST(1 + (l_orderkey * {j + 3} + l_linenumber * {7 - j}) % 11 AS DOUBLE) AS w{j}" for j in range(5)) + " FROM survey), pr AS (SELECT structure, grade, " + ", ".join(f"w{j} / (w0 + w1 + w2 + w3 + w4) AS p{j}" for j in range(5)) + " FROM ch WHERE grade IS NOT NULL)"
_CELLS = [(i, j) for i in range(5) for j in range(5)]


@query("q64_ordinal_scores", f"""WITH {v.SURVEY}, {_CHANCES}, x AS (SELECT *, list_position([p0, p1, p2, p3, p4], greatest(p0, p1, p2, p3, p4)) - 1 AS c,
    ({" + ".join(f"pow({' + '.join(f'p{i}' for i in range(j + 1))} - CAST(grade <= {j} AS INTEGER), 2)" for j in range(4))}) / 4 AS rps, {" + ".join(f"pow(p{j} - CAST(grade = {j} AS INTEGER), 2)" for j in range(5))} AS brier, -ln([p0, p1, p2, p3, p4][grade + 1]) AS loss FROM pr),
  s AS (SELECT structure, count(*) AS records, avg(rps) AS rps, avg(brier) AS brier, avg(loss) AS loss, avg(abs(grade - c)) AS mae, avg(CAST(grade = c AS INTEGER)) AS accuracy,
    {", ".join(f"CAST(count(*) FILTER (WHERE grade = {i} AND c = {j}) AS DOUBLE) AS n{i}{j}" for i, j in _CELLS)} FROM x GROUP BY 1),
  m AS (SELECT *, {", ".join(f"{' + '.join(f'n{i}{j}' for j in range(5))} AS r{i}, {' + '.join(f'n{j}{i}' for j in range(5))} AS k{i}" for i in range(5))} FROM s)
  SELECT structure, records, CAST(records AS DOUBLE) AS weight, round(rps, 9) AS ranked_probability, round(brier, 9) AS brier, round(loss, 9) AS log_loss, round(mae, 9) AS mae, round(accuracy, 9) AS accuracy,
  round(({" + ".join(f"coalesce(2 * n{i}{i} / nullif(r{i} + k{i}, 0), 0)" for i in range(5))}) / ({" + ".join(f"CAST(r{i} + k{i} > 0 AS INTEGER)" for i in range(5))}), 9) AS macro_f1,
  round(1 - ({" + ".join(f"{(i - j) ** 2} * n{i}{j}" for i, j in _CELLS)}) / (({" + ".join(f"{(i - j) ** 2} * r{i} * k{j}" for i, j in _CELLS)}) / records), 9) AS weighted_kappa FROM m""")
def q64(spark, sf):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    weights = [(1 + (key * (j + 3) + line * (7 - j)) % 11).cast("double") for j in range(5)]
    rows = v.survey(spark, sf).select("structure", "grade", *[w.alias(f"w{j}") for j, w in enumerate(weights)])
    every = F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")
    rows = rows.withColumns({f"p{j}": F.col(f"w{j}") / every for j in range(5)})
    scores = metrics.ordinal_scores(rows, "grade", [f"p{j}" for j in range(5)], ["structure"])
    return scores.withColumns({c: F.round(c, 9) for c in ("ranked_probability", "brier", "log_loss", "mae", "accuracy", "macro_f1", "weighted_kappa")})


def _mixed_sql(key: str, draw: str, seed: int) -> str:
    x = f"xor({key} & {metrics.LOW}, ({draw} * {0x9E3779B1} + {seed}) & {metrics.LOW})"
    steps = [f"h0 AS (SELECT *, {x} AS h FROM each)"]
    for k, m in enumerate((*metrics.MIX, metrics.MIX[0])):
        steps.append(f"h{k + 1} AS (SELECT * EXCLUDE (h), (xor(h, h >> 16) * {m}) & {metrics.LOW} AS h FROM h{k})")
    return ", ".join([*steps, "hashed AS (SELECT * EXCLUDE (h), xor(h, h >> 15) AS h FROM h3)"])


DRAWS = 2000


@query("q65_cluster_bootstrap", f"""WITH d AS (SELECT o_orderpriority, o_custkey, sum(CAST(o_orderstatus = 'F' AS BIGINT)) AS p, count(*) AS w FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2),
  each AS (SELECT o_orderpriority, o_custkey, p, w, draw FROM d, range({DRAWS}) t(draw)), {_mixed_sql("o_custkey", "draw", 20231005)},
  n AS (SELECT *, {" + ".join(f"CAST(h >= {c} AS INTEGER)" for c in metrics.CHANCES)} AS n FROM hashed),
  s AS (SELECT o_orderpriority, draw, CAST(sum(p * n) AS DOUBLE) / sum(w * n) AS rate FROM n GROUP BY 1, 2), q AS (SELECT o_orderpriority, quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM s GROUP BY 1)
  SELECT o_orderpriority, count(*) AS clusters, round(CAST(sum(p) AS DOUBLE) / sum(w), 9) AS estimate, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high FROM d JOIN q USING (o_orderpriority) GROUP BY 1""")
def q65(spark, sf):
    orders = v.table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "F").cast("long").alias("p"), F.lit(1).cast("long").alias("w"))
    return metrics.cluster_bootstrap(orders, "o_custkey", "p", "w", ["o_orderpriority"], DRAWS).withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})


_YEARS = "y AS (SELECT o_custkey AS year, max(o_totalprice) AS most, sum(o_totalprice) AS total FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1), n AS (SELECT max(c_custkey) AS years FROM customer)"


@query("q66_exceedance", f"""WITH {_YEARS}, r AS (SELECT 'OEP' AS curve, most AS loss FROM y UNION ALL SELECT 'AEP', total FROM y),
  k AS (SELECT curve, loss, count(*) AS times FROM r GROUP BY 1, 2), c AS (SELECT curve, loss, CAST(sum(times) OVER (PARTITION BY curve ORDER BY loss DESC) AS BIGINT) AS place FROM k)
  SELECT curve, round(loss, 4) AS loss, place, round(CAST(place AS DOUBLE) / years, 9) AS chance, round(CAST(years AS DOUBLE) / place, 9) AS return_period FROM c, n""")
def q66(spark, sf):
    """Customers stand for simulated years, their orders for the losses of a year's events."""
    years = v.table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    curves = losses.exceedance(losses.yearly(v.table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey"), years)
    return curves.withColumns({"loss": F.round("loss", 4), "chance": F.round("chance", 9), "return_period": F.round("return_period", 9)})


@query("q67_probable_losses", f"""WITH {_YEARS}, r AS (SELECT 'OEP' AS curve, most AS loss FROM y UNION ALL SELECT 'AEP', total FROM y), p(return_period) AS (VALUES (2.0), (10.0), (100.0), (250.0)),
  k AS (SELECT curve, loss, row_number() OVER (PARTITION BY curve ORDER BY loss DESC) AS place FROM r)
  SELECT curve, CAST(return_period AS DOUBLE) AS return_period, round(coalesce(min(loss) FILTER (WHERE place <= years / return_period), max(loss)), 4) AS loss, round((SELECT sum(total) FROM y) / any_value(years), 4) AS average_annual_loss
  FROM k, n, p GROUP BY 1, 2""")
def q67(spark, sf):
    years = v.table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    found = losses.probable(losses.yearly(v.table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey"), years, [2.0, 10.0, 100.0, 250.0])
    return found.withColumns({"loss": F.round("loss", 4), "average_annual_loss": F.round("average_annual_loss", 4)})


QUERIES, SQL = bindings.QUERIES, bindings.SQL
