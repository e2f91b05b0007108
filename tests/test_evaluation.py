"""Metrics, shapes, projections and file-order numbers against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlens.functions.geo import from_utm37, utm37
from tremorlens.operators import adapters, losses, metrics, validity
from tremorlens.sources import sinks, tables, vectors


def test_utm_and_back(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.uniform(-80, 84), rng.uniform(35.0, 43.0)) for _ in range(300)] + [(0.0, 39.0), (84.0, 36.0)], "la double, lo double")
    df = df.withColumns(dict(zip(("e", "n"), utm37(F.col("la"), F.col("lo"))))).withColumns(dict(zip(("a", "o"), from_utm37(F.col("e"), F.col("n")))))
    worst = df.agg(F.max(F.greatest(F.abs(F.col("la") - F.col("a")), F.abs(F.col("lo") - F.col("o"))))).first()[0]
    assert worst < 1e-9


def test_row_numbers_of_files_in_many_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text("name,value\n" + "".join(f"line {f} {k},{'x' * (k % 40)}\n" + ("\n" if k % 50 == 0 else "") for k in range(2000 + f)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = tables.read_numbered_csv(spark, str(tmp_path), ["name", "value"], lines=True)
        rows = [tuple(r) for r in df.collect()]
        assert tables.read_text_csv(spark, str(tmp_path), ["name", "value"], lines=True).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((name, row) for name, _, row in rows) == sorted((f"line {f} {k}", k + 1) for f in range(3) for k in range(2000 + f))
    (tmp_path / "q").mkdir()
    (tmp_path / "q/one.csv").write_text('name,value\n"a\nb",1\nc,\n')
    assert sorted(tuple(r) for r in tables.read_numbered_csv(spark, f"{tmp_path}/q", ["name", "value"]).collect()) == [("a\nb", "1", 1), ("c", "", 2)]


def plain_scores(rows, k):
    n = len(rows)
    best = [p.index(max(p)) for _, p in rows]
    rps = sum(sum((sum(p[: j + 1]) - (y <= j)) ** 2 for j in range(k - 1)) for y, p in rows) / (k - 1) / n
    brier = sum(sum((p[j] - (y == j)) ** 2 for j in range(k)) for y, p in rows) / n
    loss = -sum(math.log(max(p[y], 1e-15)) for y, p in rows) / n
    f1 = []
    for c in range(k):
        tp, a, b = (sum(f(y, z) for (y, _), z in zip(rows, best)) for f in (lambda y, z: y == c == z, lambda y, z: y == c, lambda y, z: z == c))
        if a + b:
            f1.append(2 * tp / (a + b))
    seen = sum((y - z) ** 2 for (y, _), z in zip(rows, best))
    chance = sum((y - z) ** 2 for y, _ in rows for z in best) / n
    return rps, brier, loss, sum(abs(y - z) for (y, _), z in zip(rows, best)) / n, sum(f1) / len(f1), 1 - seen / chance


def test_ordinal_scores_by_hand(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        p = [rng.randint(0, 6) for _ in range(4)]
        p[rng.randrange(4)] += 1
        rows.append((rng.choice([0, 0, 1, 3]), [x / sum(p) for x in p]))
    df = spark.createDataFrame([(y, *p) for y, p in rows] + [(None, 0.1, 0.2, 0.3, 0.4), (1, None, 0.5, 0.5, 0.0), (9, 1.0, 0.0, 0.0, 0.0)], "y int, a double, b double, c double, d double")
    r = metrics.ordinal_scores(df, "y", list("abcd")).first()
    assert r.records == 60 and (r.ranked_probability, r.brier, r.log_loss, r.mae, r.macro_f1, r.weighted_kappa) == pytest.approx(plain_scores(rows, 4))


def test_average_precision_and_calibration_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 1, None]), rng.choice([0.0, 0.25, 0.25, 0.5, 0.75, 1.0, None])) for _ in range(400)]
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    df = spark.createDataFrame(rows, "y int, s double").repartition(5)
    every, area = sum(y for y, _ in known), 0.0
    for t in sorted({s for _, s in known}, reverse=True):
        above = [y for y, s in known if s >= t]
        area += sum(above) / len(above) * sum(y for y, s in known if s == t) / every
    got = metrics.average_precision(df, "y", "s").first()
    assert (got.records, got.positives) == (len(known), every) and got.average_precision == pytest.approx(area)
    bins = {r.bin: (r.records, r.positive_rate) for r in metrics.calibration(df, "y", "s", 4, equal_counts=False).collect()}
    for b in range(4):
        own = [y for y, s in known if min(int(s * 4), 3) == b]
        assert bins[b] == (len(own), pytest.approx(sum(own) / len(own)))
    assert sum(r.records for r in metrics.calibration(df, "y", "s", 3).collect()) == len(known)
    assert metrics.average_precision(df.limit(0), "y", "s").first().average_precision is None


def test_bootstrap_draws_are_poisson_and_bracket_the_estimate(spark):
    drawn = metrics.with_times_drawn(spark.range(200_000).select((F.col("id") % 500).alias("g"), F.floor(F.col("id") / 500).alias("d")), "g", "d", 5, "n")
    mean, var = drawn.agg(F.mean("n"), F.var_pop("n")).first()
    assert abs(mean - 1) < 0.01 and abs(var - 1) < 0.02
    df = spark.createDataFrame([(g, (g * 7 + k) % 3 == 0) for g in range(80) for k in range(5)], "g long, y boolean").select("g", F.col("y").cast("long").alias("p"), F.lit(1).cast("long").alias("w"))
    r = metrics.cluster_bootstrap(df, "g", "p", "w", draws=500).first()
    assert r.clusters == 80 and r.low < r.estimate < r.high and r.high - r.low < 0.2
    assert [tuple(x) for x in metrics.cluster_bootstrap(df.repartition(7), "g", "p", "w", draws=500).collect()] == [tuple(r)]


def test_losses_of_return_periods(spark):
    events = spark.createDataFrame([(y, float(x)) for y, own in enumerate([[5, 3], [9], [2, 2, 2], [9, 1], []]) for x in own] + [(None, 7.0), (3, None)], "y int, x double")
    years = losses.yearly(events, "y", "x")
    curve = {(r.curve, r.loss): (r.place, r.chance) for r in losses.exceedance(years, 5).collect()}
    assert curve["OEP", 9.0] == (2, 0.4) and curve["OEP", 5.0] == (3, 0.6) and curve["AEP", 10.0] == (1, 0.2) and curve["AEP", 6.0] == (4, 0.8)
    found = {(r.curve, r.return_period): r.loss for r in losses.probable(years, 5, [1.25, 2.5, 100.0]).collect()}
    assert found == {("OEP", 1.25): 2.0, ("OEP", 2.5): 9.0, ("OEP", 100.0): 9.0, ("AEP", 1.25): 6.0, ("AEP", 2.5): 9.0, ("AEP", 100.0): 10.0}


def problems(spark, *shapes):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in shape]) for k, shape in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"id int, rings {vectors.RINGS}")
    return sorted((r.id, r.problem, r.ring) for r in validity.polygon_problems(df, "id").collect())


def test_yearly_totals_are_added_in_the_order_of_events(spark):
    """Doubles whose sum depends on the order: the total is the same however rows are dealt, and years of equal losses tie."""
    losses_of = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16]
    rows = [(y, 10 * k + y, x) for y in (1, 2) for k, x in enumerate(losses_of)]
    want = 0.0
    for x in losses_of:
        want += x
    for parts in (1, 3, 7):
        events = spark.createDataFrame(rows[::-1], "y long, k long, x double").repartition(parts)
        assert {r.year: r.total for r in losses.yearly(events, "y", "x", "k").collect()} == {1: want, 2: want}


def test_validity_edges(spark):
    box = [(0, 0), (0, 6), (6, 6), (6, 0), (0, 0)]
    nan = float("nan")
    got = problems(spark, [box], [], [[(0, 0), (0, 1), (1, 1)]], [[(0, 0), (1, 1), (0, 0)]], [[(0, 0), (0, nan), (1, 1), (0, 0)]], [[(0, 0), (2, 2), (4, 4), (0, 0)]], [[(0, 0), (0, 0), (0, 6), (6, 6), (6, 6), (6, 0), (0, 0)]], [box, [(x + 10, y) for x, y in box]])
    assert got == [(2, "open_ring", 0), (3, "few_points", 0), (4, "not_finite", 0), (5, "no_area", 0), (5, "self_crossing", 0)]


def test_validity_of_large_rings(spark):
    """A circle of many edges is valid; one that goes through itself far from where it began isn't, nor two circles that cross."""
    def circle(n, r, x0=0.0):
        ring = [(x0 + r * math.cos(-2 * math.pi * k / n), r * math.sin(-2 * math.pi * k / n)) for k in range(n)]
        return [*ring, ring[0]]

    crossed = circle(500, 10)
    crossed[250], crossed[260] = crossed[260], crossed[250]
    hole = lambda x0: circle(300, 2, x0)[::-1]
    assert {(k, p) for k, p, _ in problems(spark, [circle(500, 10)], [crossed], [circle(500, 10), hole(0.0)], [circle(500, 10), hole(9.5)], [circle(500, 10), hole(20.0)])} == {(1, "self_crossing"), (3, "rings_cross"), (4, "hole_outside")}


def test_plane_interior_points_lie_inside(spark):
    ring = lambda pts: [{"x": 37 + x / 1000, "y": 38 + y / 1000} for x, y in pts]
    rows = [(1, [ring([(0, 0), (0, 6), (6, 6), (6, 0), (0, 0)]), ring([(1, 1), (5, 1), (5, 5), (1, 5), (1, 1)])]), (2, [ring([(0, 0), (3, 6), (6, 0), (3, 1), (0, 0)])]), (3, [])]
    df = spark.createDataFrame(rows, f"id int, rings {vectors.RINGS}")
    from tremorlens.operators.proximity import in_rings

    found = vectors.with_plane_interior_point(df, "rings", "point")
    got = {r.id: r["inside"] for r in found.select("id", F.when(F.col("point").isNotNull(), in_rings(F.col("point.x"), F.col("point.y"), F.col("rings"))).alias("inside")).collect()}
    assert got == {1: True, 2: True, 3: None} and found.columns == ["id", "rings", "point"]


def test_spatial_chain_refuses_and_places(spark):
    box = lambda d: [[{"x": 37.0 + d + x, "y": 37.5 + y} for x, y in ((0, 0), (0, 0.001), (0.002, 0.001), (0.002, 0), (0, 0))]]
    shapes = spark.createDataFrame([("a", 1, 5, box(0)), ("a", 2, 5, box(0.1))], f"path string, feature long, type int, rings {vectors.RINGS}")
    fields = spark.createDataFrame([("a", 1, {"damage_lev": "2"}), ("a", 2, {"damage_lev": None})], "path string, feature long, fields map<string,string>")
    wkt = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    features = adapters.layer_features(shapes, fields, wkt, "Town")
    rows = {r.feature: r for r in adapters.layer_records(features, "layers/a.shp", F.lit("0" * 64)).select("record_id", F.col("source_row").alias("feature"), "damage_native", "latitude", "longitude", "coordinate_method").collect()}
    assert rows[1].record_id == "spatial_this_study_Town_r0000001" and rows[2].damage_native is None and rows[1].coordinate_method == "polygon_interior_point_UTM37N_to_WGS84"
    assert (rows[1].latitude, rows[1].longitude) == (pytest.approx(37.5005, abs=1e-6), pytest.approx(37.001, abs=1e-6))
    for bad in (None, "", wkt.replace("WGS_1984", "ED_1950")):
        with pytest.raises(ValueError, match="reference system"):
            adapters.layer_features(shapes, fields, bad, "Town")
    bow = [[{"x": 37.0 + x, "y": 37.0 + y} for x, y in ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))]]
    with pytest.raises(ValueError, match="feature 1: no_area"):
        adapters.layer_features(spark.createDataFrame([("a", 1, 5, bow)], shapes.schema), fields, wkt, "Town")
    with pytest.raises(ValueError, match="without geometry"):
        adapters.layer_features(spark.createDataFrame([("a", 1, 0, [])], shapes.schema), fields, wkt, "Town")


def test_json_keeps_to_finite_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf")), (4, None)], "k int, x double")
    sinks.write_json(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"k":1,"x":1.5}', '{"k":2,"x":null}', '{"k":3,"x":null}', '{"k":4,"x":null}']
    assert "The first 2 rows" in sinks.markdown_table(df, 2) and "The first" not in sinks.markdown_table(df, 4)
