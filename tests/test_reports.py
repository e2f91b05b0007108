import json

import pytest
from pyspark.sql import functions as F

from tremorlens.operators import adapters
from tremorlens.operators.harmonize import SCHEMA
from tremorlens.plans import reports


def survey(spark, rows):
    columns = "row long, building_id string, city string, floors double, structure_type string, damage_label string, damage_grade int, latitude double, longitude double, PGA double, PGV double, SA_0p3 double, SA_1p0 double"
    return spark.createDataFrame(rows, columns)


SURVEY = [
    (1, "b1", "A", 3.0, "RC MRF", "Minor", 1, 37.0, 36.0, 0.2, 4.0, 0.5, 0.1), (2, "b2", "A", 2.0, "URM", "Severe", 3, 37.5, 36.0, 0.3, None, 0.5, 0.1),
    (3, "b3", "B", None, None, None, None, 38.0, 36.0, 0.4, 5.0, float("inf"), -1.0), (4, "b4", "C", 1.0, "RC MRF", "None", 0, 39.0, 36.0, 0.5, 6.0, 0.6, 0.2),
]


def test_survey_and_site_records(spark):
    out = adapters.survey_records(survey(spark, SURVEY), "a.parquet", "a" * 64)
    assert out.schema == SCHEMA or [f.name for f in out.schema] == [f.name for f in SCHEMA]
    adapters.assert_known_sources(out)
    rows = {r.source_row: r for r in out.collect()}
    assert (rows[1].record_id, rows[1].structure_family, rows[1].high_damage_candidate, rows[2].high_damage_candidate, rows[2].structure_family) == ("turkiye_survey_r0000001", "RC", 0, 1, None)
    assert (rows[3].high_damage_candidate, rows[3].damage_mapping_status, rows[1].license, rows[1].im_event_id) == (None, "provisional_not_for_pooling", "CC-BY-4.0", None)
    sheet = spark.createDataFrame([(1, "s1", "5", "C", "37.0", "36.0", True), (2, "s2", "4", "N", "37.1", "36.1", False)], "row long, c001 string, c003 string, c021 string, c037 string, c038 string, supplemented boolean")
    out = adapters.site_records(sheet, "b.xlsx", "b" * 64)
    adapters.assert_known_sources(out)
    assert sorted((r.source_id_native, r.damage_ordinal_native, r.author_supplemented, r.floors) for r in out.collect()) == [("aci133_s1", 4, True, 5.0), ("aci133_s2", 0, False, 4.0)]
    with pytest.raises(ValueError, match="unknown label"):
        adapters.site_records(sheet.withColumn("c021", F.lit("R")), "b.xlsx", "b" * 64)
    with pytest.raises(ValueError, match="repeated"):
        adapters.site_records(sheet.withColumn("c001", F.lit("s")), "b.xlsx", "b" * 64)


RAW = 'row long, `Experiment ID` string, `Case Name` string, `Case ID` string, Latitude string, Longitude string, `No. \nFloors` string, `Structural \nDamage` string'


def test_cohort_keeps_undocumented_labels(spark):
    haiti = "Measures of the seismic vulnerability of reinforced concrete buildings in Haiti"
    raw = spark.createDataFrame([(1, "e1", haiti, "c", "18.5", "-72.3", "2", "N"), (2, "e2", haiti, "c", "", "", "", "R"), (3, "e3", haiti, "c", "18.6", "-72.2", "3", "C")], RAW)
    table = adapters.cohort_table(raw)
    out = adapters.cohort_records(table, "c.csv", "c" * 64)
    adapters.assert_known_sources(out)
    rows = {r.source_row: r for r in out.collect()}
    assert (rows[2].damage_native, rows[2].damage_ordinal_native, rows[2].high_damage_candidate, rows[2].coordinate_status) == ("R", None, None, "missing")
    assert (rows[3].high_damage_candidate, rows[1].country, rows[1].floors_native, rows[1].event_id) == (1, "HTI", "2", "haiti_2010")
    with pytest.raises(ValueError, match="unknown event"):
        adapters.cohort_table(raw.withColumn("Case Name", F.lit("other")))
    with pytest.raises(ValueError, match="repeated"):
        adapters.cohort_table(raw.withColumn("Experiment ID", F.lit("e")))
    with pytest.raises(Exception, match="not a number"):
        adapters.cohort_table(raw.withColumn("Latitude", F.lit("north"))).collect()


def test_census_scale_stays_native(spark):
    raw = spark.createDataFrame([(k, "1e9", "d1" if k < 3 else "d2", "v", "w", g, f"H:{k}") for k, g in ((1, "Grade 1"), (2, "Grade 5"), (3, ""))], "row long, BUILDING_ID string, DISTRICT_ID string, VDCMUN_ID string, WARD_ID string, DAMAGE_GRADE string, BUILDING_FLOORS string")
    out = adapters.census_records(raw, "n.csv", "d" * 64)
    adapters.assert_known_sources(out)
    assert [(r.damage_ordinal_native, r.high_damage_candidate, r.floors, r.damage_mapping_status) for r in out.orderBy("source_row").collect()] == [(1, None, 1.0, "native_only"), (5, None, 2.0, "native_only"), (None, None, 3.0, "native_only")]
    with pytest.raises(ValueError, match="encoded"):
        adapters.census_records(raw.withColumn("BUILDING_FLOORS", F.lit("3")), "n.csv", "d" * 64)
    official = spark.createDataFrame([("d1", "One", 2), ("d2", "Two", 9)], "value string, category string, frequency long")
    assert sorted(tuple(r) for r in adapters.census_reconciliation(raw, official).collect()) == [("d1", "One", 2, 2, True), ("d2", "Two", 1, 9, False)]


def test_layer_records_have_no_ordinal(spark):
    features = spark.createDataFrame([("A", 1, "4", (36.5, 37.5)), ("J", 1, None, (36.6, 36.4))], "city string, feature long, damage_lev string, point struct<x:double,y:double>")
    out = adapters.layer_records(features, "x.shp", F.lit("e" * 64), {"J": "SYR"})
    adapters.assert_known_sources(out)
    assert sorted((r.record_id, r.country, r.damage_native, r.damage_ordinal_native, r.latitude) for r in out.collect()) == [("spatial_this_study_A_r0000001", "TUR", "4", None, 37.5), ("spatial_this_study_J_r0000001", "SYR", None, None, 36.4)]
    with pytest.raises(ValueError, match="ordinal_forbidden"):
        adapters.assert_known_sources(out.withColumn("damage_ordinal_native", F.lit(4)))


def test_design_run(spark, tmp_path):
    a = adapters.survey_records(survey(spark, [*SURVEY, (5, "b5", "C", 1.0, "x", "Minor", 1, 37.0001, 36.0, 0.1, 1.0, 1.0, 1.0)]), "a", "a" * 64)
    sheet = spark.createDataFrame([(1, "s1", "5", "C", "38.0", "36.0", True), (2, "s2", "4", "N", "10.0", "36.1", False)], "row long, c001 string, c003 string, c021 string, c037 string, c038 string, supplemented boolean")
    b = adapters.site_records(sheet, "b", "b" * 64)
    e = reports.Experiment("cities", "turkiye_survey", "city", ("A", "B", "C"), conflicts=True, grouped_by_place=True)
    got = reports.make_design({"turkiye_survey": a, "aci133": b}, [e], str(tmp_path), near=("turkiye_survey", "aci133"), external="aci133", contract=adapters.CONTRACT)
    fold = got["experiments"]["cities"]["folds"][0]
    assert (fold["test_domain"], fold["validation_domain"], fold["training_domains"]) == ("A", "B", ["C"])
    assert fold["exclusions"] == {"group_crosses_domain_partition": 2, "missing_or_unmapped_native_damage": 1} and fold["empty_partition"] and fold["small_test_warning"]
    assert fold["test"]["native_class_counts"] == {"Severe": 1} and fold["excluded"]["native_class_counts"] == {"<missing>": 1, "Minor": 2}
    assert got["aci133_reserved"] == {"records": 2, "proximity_connected_to_survey": 1, "evaluation_enabled": False}
    assert spark.read.parquet(str(tmp_path / "cities")).count() == 15
    assert json.loads(spark.read.text(str(tmp_path / "summary.json"), wholetext=True).first()[0]) == got
    with pytest.raises(ValueError, match="domains of turkiye_survey changed"):
        reports.make_design({"turkiye_survey": a}, [reports.Experiment("x", "turkiye_survey", "city", ("A", "B"))], str(tmp_path), contract=adapters.CONTRACT)
    near = reports.Experiment("s", "turkiye_survey", "city", ("A", "B", "C"), spatial=True)
    with pytest.raises(ValueError, match="may be"):
        reports.make_design({"turkiye_survey": a}, [near], str(tmp_path), contract=adapters.CONTRACT)


def test_eda_run(spark, tmp_path):
    got = reports.run_eda(survey(spark, SURVEY), str(tmp_path))
    assert (got["records"], got["known_damage"], got["damage_and_structure"], got["unique_valid_coordinates"]) == (4, 3, 3, 4)
    assert got["damage_class_counts"] == {"0": 1, "1": 1, "2": 0, "3": 1, "4": 0, "NA": 1}
    assert got["shaking_plot_accounting"]["SA_0p3"] == {"used": 3, "missing": 0, "invalid": 1, "min": 0.5, "max": 0.6}
    rates = spark.read.csv(str(tmp_path / "damage_rate_by_structure.csv"), header=True)
    assert sorted((r.structure, r.damage_rate) for r in rates.collect()) == [("<missing>", None), ("RC MRF", "0.5"), ("URM", "1.0")]
    assert "distinct valid" in spark.read.text(str(tmp_path / "report.md"), wholetext=True).first()[0]
