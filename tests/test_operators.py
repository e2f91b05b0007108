import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlens.functions.geo import haversine, valid_coordinates
from tremorlens.functions.text import iso_timestamp, normalize, numbered, safe_double
from tremorlens.operators.neighbours import nearest_by_bounds
from tremorlens.operators import canonical, design, explore, groups, harmonize, profile, proximity, quality, reconcile

D = design.Columns("record", "city", "grp", "event", "la", "lo", "label", "ordinal")
ROWS = "record string, city string, grp string, event string, la double, lo double, label string, ordinal int"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_text_helpers(spark):
    df = spark.createDataFrame([("  x ",), ("  ",), ("None",), (None,), ("1.0d",), ("NaN",), ("-Inf",), ("5.",), ("+.5e1",), ("2023-02-30",), ("2023-02-03",)], "t string")
    got = df.select(normalize(F.col("t")).alias("n"), safe_double(F.col("t")).alias("d"), iso_timestamp(F.col("t")).cast("string").alias("s")).collect()
    assert [r.n for r in got[:4]] == ["x", None, "None", None]
    assert [r.d for r in got[4:9]] == [None, None, -math.inf, 5.0, 5.0]
    assert [r.s for r in got[9:]] == [None, "2023-02-03 00:00:00"]
    assert spark.range(1).select(numbered("r%04d", F.lit(12345))).first()[0] == "r12345"


def test_haversine_and_validity(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    assert df.select(haversine(*map(F.col, "abcd"))).first()[0] == pytest.approx(111195.08, abs=0.1)
    points = spark.createDataFrame([(37.0, 36.0), (0.0, 0.0), (91.0, 1.0), (None, 1.0), (math.nan, 1.0), (math.inf, 1.0), (-90.0, 180.0)], "la double, lo double")
    assert [r[0] for r in points.select(valid_coordinates(F.col("la"), F.col("lo"))).collect()] == [True, False, False, False, False, False, True]


def test_damage_rates_and_missing(spark):
    df = spark.createDataFrame([("a", 0), ("a", 4), ("a", None), ("b", None), (None, 2)], "s string, g int")
    assert values(explore.damage_rates(df, "s", "g"), "structure", "total", "known", "missing")[:2] == [("<missing>", 1, 1, 0), ("a", 3, 2, 1)]
    rates = {r.structure: r.damage_rate for r in explore.damage_rates(df, "s", "g").collect()}
    assert rates == {"a": 0.5, "b": None, "<missing>": 1.0}
    assert explore.damage_rates(df.limit(0), "s", "g").count() == 0


def test_canonicalize_keeps_everything(spark):
    fields = [canonical.Field("label", "label"), canonical.Field("x", "x", "number"), canonical.Field("d", "d", "date")]
    df = spark.createDataFrame([(1, " Minor ", "1000", "2023-01-01"), (2, "None", "not numeric", "not a date"), (3, "odd", " ", None), (4, None, None, "")], "id int, label string, x string, d string")
    out = canonical.canonicalize(df, fields, "id", "label", {"Minor": 1, "None": 0})
    assert values(out.where("id < 3"), "id", "damage_grade", "raw__x") == [(1, 1, "1000"), (2, 0, "not numeric")]
    assert values(canonical.issue_rows(out, "id"), "id", "field", "kind", "raw_value") == [
        (2, "d", "date_parse_error", "not a date"), (2, "x", "numeric_parse_error", "not numeric"), (3, "label", "unmapped_damage_label", "odd")]
    with pytest.raises(ValueError, match="columns differ"):
        canonical.canonicalize(df.drop("x"), fields, "id")
    assert canonical.schema_violations(df, harmonize.SCHEMA)


def test_quality_rules_never_drop_rows(spark):
    df = spark.createDataFrame([(1, 91.0, -181.0, 2.5), (2, 0.0, 0.0, 0.0), (3, math.inf, 1.0, math.inf), (4, None, None, None), (5, 37.0, 36.0, 3.0)], "id int, la double, lo double, floors double")
    found = quality.violations(df, "id", [*quality.coordinate_rules("la", "lo"), quality.whole_number("floors", 1)])
    assert values(found, "id", "field") == [(1, "floors"), (1, "la"), (1, "lo"), (2, "floors"), (2, "la"), (3, "floors"), (3, "la")]
    with pytest.raises(ValueError):
        quality.fail_on_errors(found)


def test_coordinate_profile(spark):
    df = spark.createDataFrame(list(zip([37.0, 37.0, None, None, 95.0, 0.0], [36.0, 36.0, None, None, 36.0, 0.0])), "la double, lo double")
    r = profile.coordinate_profile(df, "la", "lo").first()
    assert (r.unique_valid, r.duplicate_rows, r.missing, r.invalid) == (1, 2, 2, 2)


def test_attach_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    assert values(groups.attach(df, ["k"], {"n": F.count(F.lit(1))}), "id", "n") == [(1, 2), (2, 2), (3, 1)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    roots = dict(values(groups.components(edges, "a", "b"), "node", "root"))
    assert roots == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_proximity_groups_are_transitive_and_ordered(spark):
    rows = [("a", 37.0, 36.0), ("b", 37.0, 36.0009), ("c", 37.0, 36.0018), ("d", 0.0, 0.0), ("e", None, None), ("f", 37.0, 36.0)]
    one = proximity.proximity_groups(spark.createDataFrame(rows, "id string, la double, lo double"), "id", "la", "lo", 100)
    two = proximity.proximity_groups(spark.createDataFrame(rows[::-1], "id string, la double, lo double"), "id", "la", "lo", 100)
    sites = dict(values(one, "id", "site"))
    assert sites == dict(values(two, "id", "site")) and len({sites[k] for k in "abcf"}) == 1 and len(set(sites.values())) == 3


def test_pairs_equal_all_pairs_anywhere(spark):
    points = [(k, lat, lon) for k, (lat, lon) in enumerate([(89.9, 10.0), (89.9, -170.0), (-16.5, 179.9999), (-16.5, -179.9999), (0.001, 0.0), (0.0, 0.001), (60.0, 5.0), (60.0, 5.015)])]
    df = spark.createDataFrame(points, "id int, la double, lo double")
    for radius in (200.0, 1000.0, 30_000.0):
        got = values(proximity.self_pairs(df, "id", "la", "lo", radius), "first", "second")
        a, b = df.toDF("i", "a1", "o1"), df.toDF("j", "a2", "o2")
        want = values(a.join(b, F.col("i") < F.col("j")).where(haversine(*map(F.col, ("a1", "o1", "a2", "o2"))) <= radius), "i", "j")
        assert got == want


def test_pairs_equal_all_pairs_near_poles_and_at_random(spark):
    rng = random.Random(7)
    points = [(k, rng.choice([89.9995, 89.99, -89.999, 89.5, 70.0, 45.0]) + rng.uniform(-0.0004, 0.0004), rng.uniform(-180, 180) if k % 2 else rng.choice([10.0, 179.9995, -179.9995]) + rng.uniform(-0.002, 0.002)) for k in range(240)]
    df = spark.createDataFrame([(k, max(-90.0, min(90.0, la)), max(-180.0, min(180.0, lo))) for k, la, lo in points], "id int, la double, lo double")
    a, b = df.toDF("i", "a1", "o1"), df.toDF("j", "a2", "o2")
    every = a.join(b, F.col("i") < F.col("j")).select("i", "j", haversine(*map(F.col, ("a1", "o1", "a2", "o2"))).alias("d")).collect()
    for radius in (40.0, 100.0, 5_000.0, 300_000.0, 9e6):
        assert values(proximity.self_pairs(df, "id", "la", "lo", radius), "first", "second") == sorted((r.i, r.j) for r in every if r.d <= radius)


def test_a_polar_row_leaves_cells_elsewhere_alone(spark):
    height = proximity._height(100.0)
    df = spark.createDataFrame([(38.0,), (89.9999,), (90.0,), (0.0,)], "la double").withColumn("y", F.floor(F.col("la") / height).cast("long"))
    cells = [r[0] for r in df.select(proximity._around(F.col("y"), height, 100.0)).collect()]
    assert cells[0] > 300_000 and cells[1] <= 8 and cells[2] == 1 and cells[3] > 400_000


def test_nearest_with_outliers(spark):
    left = spark.createDataFrame([(1, 37.0, 36.0), (2, -60.0, -170.0), (3, 89.9999, 0.0), (4, None, 1.0), (5, 37.0, 36.0), (6, 0.0, 0.0)], "id int, la double, lo double")
    right = spark.createDataFrame([(1, 37.001, 36.0), (2, 38.0, 36.0), (3, None, 2.0)], "st int, la double, lo double")
    got = {r.id: r.distance for r in proximity.nearest(left, right, "id", "st", "la", "lo", 500.0).collect()}
    ok = left.where("la is not null and la <> 0").crossJoin(right.where("la is not null").toDF("st", "b", "o"))
    assert got == {r.id: r.d for r in ok.groupBy("id").agg(F.min(haversine(*map(F.col, ("la", "lo", "b", "o")))).alias("d")).collect()} and len(got) == 4
    assert proximity.nearest(left, right.limit(0), "id", "st", "la", "lo", 500.0).collect() == []


@pytest.mark.parametrize(("leaf", "opened"), [(1, 1), (2, 3), (32, 8)])
def test_nearest_by_bounds_equals_all_pairs(spark, leaf, opened):
    """Clusters, antipodes, poles, both sides of the antimeridian, repeated places; few cells at a time change nothing."""
    rng = random.Random(leaf)
    def some(n):
        near = [(37 + rng.random() / 50, 36 + rng.random() / 50) for _ in range(n)]
        return near + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n // 3)] + [(90.0, 5.0), (-90.0, 0.0), (10.0, 180.0), (10.0, -179.9999), (-37.01, -143.99)]
    right = [(k, *p) for k, p in enumerate(some(60) + [(37.001, 36.001)] * 3)]
    left = [(k, *p) for k, p in enumerate(some(40))]
    a, b = spark.createDataFrame(left, "id int, la double, lo double"), spark.createDataFrame(right, "st int, la double, lo double")
    got = {(r.la, r.lo): r.distance for r in nearest_by_bounds(a, b, "la", "lo", leaf, opened).collect()}
    want = {(r.la, r.lo): r.d for r in a.crossJoin(b.toDF("st", "b", "o")).groupBy("la", "lo").agg(F.min(haversine(*map(F.col, ("la", "lo", "b", "o")))).alias("d")).collect()}
    assert got == want


def test_grid_join_compiles(spark):
    """Generated code of every stage is small enough; without the fallback a stage that doesn't compile fails."""
    df = spark.createDataFrame([(k, 37 + k / 1e4, 36.0) for k in range(50)], "id int, la double, lo double")
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert proximity.self_pairs(df, "id", "la", "lo", 100.0).count() == 8 * 50 - 36
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def _stacked(spark, records: int, key: str, shift: float = 0.0):
    """So many records at one place, and one record at another."""
    at = F.when(F.col("id") == 0, 38.0).otherwise(37.0 + shift)
    return spark.range(records + 1).select(F.col("id").alias(key), at.alias("la"), F.lit(36.0).alias("lo"))


def test_pairs_of_one_place_are_dealt_over_tasks(spark):
    """2,500 x 2,500 records at two places: all pairs, and no task makes many more than it should."""
    pairs = proximity.pairs_within(_stacked(spark, 2500, "id"), _stacked(spark, 2500, "st", 0.001), "id", "st", "la", "lo", 400.0)
    by = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by) == 2500 * 2500 + 1 and max(r["count"] for r in by) <= 2 * proximity.PAIRS
    few = spark.createDataFrame([(None, 37.0, 36.0), (1, 37.0, 36.0), (1, 37.0, 36.0)], "id long, la double, lo double")
    assert sorted(map(str, proximity.pairs_within(few, few.withColumnRenamed("id", "st"), "id", "st", "la", "lo", 1.0).select("id", "st").toPandas()["id"])) == ["1.0"] * 6 + ["nan"] * 3


def test_overlap_counts_pairs_without_making_them(spark):
    """40,000 x 40,000 records at two places would be 1.6 billion pairs."""
    a, b = _stacked(spark, 40_000, "id"), _stacked(spark, 40_000, "st", 0.001)
    got = {r.threshold: (r.pairs, r.left_records, r.right_records) for r in proximity.overlap_by_threshold(a, b, "id", "st", "la", "lo", [0, 50, 200]).collect()}
    assert got == {0.0: (1, 1, 1), 50.0: (1, 1, 1), 200.0: (40_000**2 + 1, 40_001, 40_001)}


def test_nearest_compares_places_not_records(spark, monkeypatch):
    sizes, near = [], proximity._near
    monkeypatch.setattr(proximity, "_near", lambda a, b, radius: sizes.append((a.count(), b.count())) or near(a, b, radius))
    got = proximity.nearest(_stacked(spark, 3000, "id"), _stacked(spark, 3000, "st", 0.001), "id", "st", "la", "lo", 500.0).collect()
    assert sizes == [(2, 2)] and len(got) == 3001 and len({r.distance for r in got}) == 2


def test_counts_by_polygon_equal_its_pairs(spark, monkeypatch):
    """Alike polygons and points at one place are tested once; identifiers at several places count once."""
    square = lambda x: [[(x, 0.0), (x + 0.03, 0.0), (x + 0.03, 0.03), (x, 0.03)]]
    polygons = spark.createDataFrame([(k, square(0.01 * (k % 3))) for k in range(9)], "poly long, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(k // 2 if k > 30 else k, 0.005 * (k % 11), 0.01) for k in range(60)], "pt long, px double, py double")
    sizes, pairs = [], proximity.points_in_polygons
    want = pairs(points, polygons, "pt", "poly", "px", "py", "rings").groupBy("poly").agg(F.count_distinct("pt"), F.min("pt")).collect()
    monkeypatch.setattr(proximity, "points_in_polygons", lambda a, b, *rest: sizes.append((a.count(), b.count())) or pairs(a, b, *rest))
    got = proximity.points_by_polygon(points, polygons, "pt", "poly", "px", "py", "rings").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 9 and sizes == [(11, 3)]


def test_points_in_polygons_equal_all_pairs(spark):
    rng = random.Random(5)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [(k, [square(rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.001, 0.05, 1.5]))]) for k in range(30)]
    shapes += [(30, [square(-1.0, -1.0, 2.0), square(-0.5, -0.5, 1.0)]), (31, []), (32, [[]])]
    polygons = spark.createDataFrame(shapes, "poly int, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(k, rng.uniform(-2, 2), rng.uniform(-2, 2)) for k in range(300)] + [(900, -1.0, 0.3), (901, 0.0, 0.0), (902, None, 1.0)], "pt int, px double, py double")
    got = values(proximity.points_in_polygons(points, polygons, "pt", "poly", "px", "py", "rings", cell=0.02), "pt", "poly")
    every = points.crossJoin(polygons).where(proximity.in_rings(F.col("px"), F.col("py"), F.col("rings")))
    assert got == values(every, "pt", "poly") and (900, 30) in got and (901, 30) not in got and len(got) > 50


def test_gaps_are_checked(spark):
    gaps = proximity.box_gaps(spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 0.0), ("b", 13.0, 4.0)], "g string, x double, y double"), "g", "x", "y")
    assert gaps.first().gap == 5.0
    proximity.assert_gaps(gaps, 5.0)
    with pytest.raises(ValueError, match="a and b"):
        proximity.assert_gaps(gaps, 5.1)


def test_point_in_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1.0, 1.0, ring), (2.0, 3.0, ring), (4.0, 2.0, ring), (5.0, 1.0, ring)], "x double, y double, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(proximity.point_in_polygon(F.col("x"), F.col("y"), F.col("ring"))).collect()] == [True, False, True, False]


def fixture(spark, change=()):
    rows = [["r0", "A", "A", "e", 37.0, 36.0, "Minor", 1], ["r1", "A", "A", "e", 37.0, 36.0, "Minor", 1], ["r2", "B", "B", "e", 38.0, 36.0, "Minor", 1], ["r3", "C", "C", "e", 39.0, 36.0, "Minor", 1]]
    for k, c, value in change:
        rows[k][c] = value
    return spark.createDataFrame(rows, ROWS)


def test_violations_without_multiplying_rows_by_folds(spark, monkeypatch):
    """Equal to those counted over all folds' rows; one record comes twice, in a group of several domains."""
    rows = [(k % 37, f"d{k % 5}" if k % 11 else None, f"g{k % 7}" if k % 3 else None, "e", 37.0 + (k % 4) / 10, 36.0, f"l{k % 2}", k % 3 or None) for k in range(40)]
    df = spark.createDataFrame(rows, "record long, domain string, grp string, event string, la double, lo double, label string, ordinal int")
    c, folds = design.Columns("record", "domain", "grp", "event", "la", "lo", "label", "ordinal"), design.cyclic_folds([f"d{k}" for k in range(5)])
    prepared = design.prepare(df, c, folds, conflicts=False)
    names = ["fold", "weighed_exclusions", "repeated_records", "split_groups"]
    want = sorted(map(tuple, design.disjoint_violations(design.parts_of(prepared, folds)).select(*names).collect()))
    monkeypatch.setattr(design, "_in_folds", None)
    assert sorted(map(tuple, design.violations_of(prepared, folds).select(*names).collect())) == want and want[0][2] == 3
    # Groups that are said not to cross are found split.
    apart = prepared.withColumn("_cross", F.array(*[F.lit(False)] * len(folds)))
    assert any(r.split_groups for r in design.violations_of(apart, folds).collect())
    assert design.violations_of(design.prepare(df.limit(0), c, folds), folds).count() == 0


@pytest.mark.parametrize(
    ("change", "roles", "weights", "reason"),
    [
        ((), ["train", "train", "validation", "test"], [0.5, 0.5, 1, 1], None),
        ([(1, 1, "C")], ["excluded", "excluded", "validation", "test"], [0, 0, 1, 1], "group_crosses_domain_partition"),
        ([(1, 6, "Severe")], ["excluded", "excluded", "validation", "test"], [0, 0, 1, 1], "conflicting_labels_at_exact_coordinate"),
        ([(1, 6, "Severe"), (1, 3, "other")], ["excluded", "excluded", "validation", "test"], [0, 0, 1, 1], "conflicting_labels_at_exact_coordinate"),
        ([(1, 7, 3)], ["train", "train", "validation", "test"], [0.5, 0.5, 1, 1], None),
        ([(1, 6, None), (1, 7, None)], ["train", "excluded", "validation", "test"], [1, 0, 1, 1], "missing_or_unmapped_native_damage"),
        ([(1, 4, None)], ["train", "excluded", "validation", "test"], [1, 0, 1, 1], "missing_or_invalid_coordinate"),
        ([(1, 1, None)], ["train", "excluded", "validation", "test"], [1, 0, 1, 1], "missing_domain"),
    ],
)
def test_partition(spark, change, roles, weights, reason):
    parts = design.partition_folds(fixture(spark, change), D, [design.Fold("f", "C", "B")], coordinate_required=True)
    rows = sorted(parts.collect(), key=lambda r: r.record_id)
    assert [r.partition for r in rows] == roles and [r.evaluation_weight for r in rows] == weights
    assert {r.exclusion_reason for r in rows if r.partition == "excluded"} == ({reason} if reason else set())
    design.assert_disjoint(parts)


def test_folds_cover_each_domain_once(spark):
    folds = design.cyclic_folds(["A", "B", "C"], {"C": "B"})
    assert [(f.test, f.validation) for f in folds] == [("A", "B"), ("B", "C"), ("C", "B")]
    with pytest.raises(ValueError):
        design.Fold("x", "A", "A")
    counts = design.fold_counts(fixture(spark), D, folds)
    sums = design.fold_summary(counts)
    assert sums.count() == 12 and sums.where("empty").count() == 0 and sums.where("small").count() == 6
    assert values(design.fold_classes(counts), "fold", "item", "key", "records")[:3] == [("fold_A", "test", "Minor", 2), ("fold_A", "train", "Minor", 1), ("fold_A", "validation", "Minor", 1)]


def test_fold_counts_equal_counted_rows(spark):
    df = fixture(spark, [(1, 1, "C"), (3, 6, None), (3, 7, None)])
    folds = design.cyclic_folds(["A", "B", "C"])
    rows = design.partition_folds(df, D, folds).groupBy("fold", "partition", "exclusion_reason", "leakage_group").agg(F.count(F.lit(1)).alias("records"), F.sum("evaluation_weight").alias("weight"))
    counted = design.fold_counts(df, D, folds).groupBy("fold", "partition", "exclusion_reason", "leakage_group").agg(F.sum("records").alias("records"), F.sum("weight").alias("weight"))
    assert values(rows, *rows.columns) == values(counted, *rows.columns)


GOLDEN = [("rural", 5, 2), ("town", 40, 0), ("city", 31, 3)]


def test_fold_summary_of_published_shape(spark):
    """A row for each kept and excluded record of a domain; every fold must give them all back in its roles."""
    rows = [(f"{d}{k}", d, d, "e", 37.0 + len(d) / 10 + k / 1000, 36.0, "Minor", 1 if k < n else None) for d, n, out in GOLDEN for k in range(n + out)]
    folds = design.cyclic_folds([d for d, _, _ in GOLDEN])
    got = {(r.fold, r.partition): (r.records, r.small) for r in design.fold_summary(design.fold_counts(spark.createDataFrame(rows, ROWS), D, folds)).collect()}
    kept, out = {d: n for d, n, _ in GOLDEN}, sum(x for _, _, x in GOLDEN)
    for f in folds:
        train = sum(n for d, n in kept.items() if d not in (f.test, f.validation))
        assert [got[f.name, p][0] for p in ("train", "validation", "test", "excluded")] == [train, kept[f.validation], kept[f.test], out]
        assert got[f.name, "test"][1] == (kept[f.test] < 30)


def record(spark, dataset="x", **change):
    df = spark.createDataFrame([(1, 37.0, 36.0), (2, None, 1.0), (3, 0.0, 0.0)], "id int, la double, lo double")
    given = {"latitude": F.col("la"), "longitude": F.col("lo"), "source_row": F.col("id"), "event_id": F.lit("e")} | change
    return harmonize.harmonize(df, dataset, "x.csv", "a" * 64, given)


def test_harmonized_schema(spark):
    out = record(spark)
    assert canonical.schema_violations(out, harmonize.SCHEMA) == []
    assert [r.coordinate_status for r in out.orderBy("source_row").collect()] == ["valid_range_only", "missing", "invalid"]
    first = out.orderBy("source_row").first()
    assert (first.record_id, first.damage_scale, first.damage_mapping_status, first.im_status) == ("x_r0000001", "x_native", "native_only", "not_present")
    harmonize.assert_records(out)
    again = out.unionByName(out.limit(1))
    assert values(harmonize.record_violations(again).where("records > 0"), "rule", "records") == [("repeated_record_id", 1)]
    with pytest.raises(ValueError):
        record(spark, colour=F.lit(1))
    with pytest.raises(ValueError, match="columns differ"):
        harmonize.assert_records(out.withColumn("floors", F.col("floors").cast("string")))


@pytest.mark.parametrize(
    ("dataset", "change", "rule"),
    [
        ("x", {"event_id": None}, "missing_required"), ("x", {"high_damage_candidate": 1}, "candidate_not_provisional"), ("x", {"damage_ordinal_native": 5}, "ordinal_range"),
        ("census", {"damage_ordinal_native": 0}, "ordinal_range"), ("census", {"high_damage_candidate": 0, "damage_mapping_status": "provisional_not_for_pooling"}, "candidate_forbidden"),
        ("spatial", {"damage_ordinal_native": 4}, "ordinal_forbidden"), ("spatial", {"high_damage_candidate": 1, "damage_mapping_status": "provisional_not_for_pooling"}, "ordinal_forbidden"),
        ("x", {"source_sha256": "A" * 64}, "bad_hash"),
    ],
)
def test_record_contract_refuses(spark, dataset, change, rule):
    contract = {"ordinals": {"census": (1, 5)}, "no_candidate": ("census",), "no_ordinal": ("spatial",)}
    out = record(spark, dataset, **{k: F.lit(x) for k, x in change.items()})
    with pytest.raises(ValueError, match=rule):
        harmonize.assert_records(out, **contract)
    ok = record(spark, dataset, **({"damage_ordinal_native": F.lit(1)} if dataset != "spatial" else {}))
    harmonize.assert_records(ok, **contract)


def test_reconcile_and_drift(spark):
    a, b = spark.createDataFrame([("x", 1), (None, 2)], "k string, n int"), spark.createDataFrame([("x", 1), ("y", 3)], "k string, n int")
    assert sorted(map(tuple, reconcile.reconcile(a, b, "k", "n").collect()), key=str) == [("x", 1, 1, True), ("y", None, 3, False), (None, 2, None, False)]
    assert values(reconcile.domain_drift(b, "k", ["x", "z"]), "value", "side") == [("y", "unexpected"), ("z", "absent")]
    assert reconcile.same_rows(a, a) and not reconcile.same_rows(a, b)


@pytest.mark.parametrize("values_of", [lambda k: float(k), lambda k: 5.0, lambda k: float(k % 3), lambda k: 1.0 / (k + 1) ** 3, lambda k: -float(k * k)])
def test_exact_quantiles(spark, values_of):
    from tremorlens.operators.summaries import exact_quantiles

    df = spark.createDataFrame([(g, values_of(k)) for g, n in (("a", 1), ("b", 2), (None, 57), ("c", 100)) for k in range(n)] + [("c", None)], "g string, x double")
    each = [{r.g: (r.q1, r.q2) for r in exact_quantiles(df, "g", "x", {"q1": 0.25, "q2": 0.9}, counted=n).collect()} for n in (10, 1 << 20)]
    assert each[0].keys() == each[1].keys() and all(each[0][g] == pytest.approx(each[1][g]) for g in each[0])
    got = each[0]
    want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
