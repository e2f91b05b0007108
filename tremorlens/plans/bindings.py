"""Queries of the library bound to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import grid_cell, utm37, valid_coordinates
from ..functions.text import cell_text, lookup, numbered, strict_double, without_prefix, zero_filled
from ..operators import canonical, design, explore, harmonize, profile, proximity, quality, reconcile
from ..sources.binary import png_header, unsafe_member
from ..sources.markup import html_pairs, html_title, preferred
from ..sources.tables import check_files, digests, sidecar_hash, sniff
from . import harmonized as h
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("q01_damage_rates", f"""WITH {v.SURVEY} SELECT coalesce(structure, '<missing>') AS structure, count(*) AS total, count(grade) AS known, count(*) - count(grade) AS missing,
  count(*) FILTER (WHERE grade >= 1) AS damaged, count(*) FILTER (WHERE grade >= 3) AS severe,
  round(CAST(count(*) FILTER (WHERE grade >= 1) AS DOUBLE) / nullif(count(grade), 0), 9) AS damage_rate FROM survey GROUP BY 1""")
def q01(spark, sf):
    return explore.damage_rates(v.survey(spark, sf), "structure", "grade")


@query("q02_class_counts", f"""WITH {v.SURVEY}, k AS (SELECT * FROM (VALUES (0, '0'), (1, '1'), (2, '2'), (3, '3'), (4, '4'), (5, '5'), (6, 'NA')) t(position, class))
  SELECT position, k.class, count(s.l_orderkey) AS records FROM k LEFT JOIN survey s ON coalesce(CAST(grade AS VARCHAR), 'NA') = k.class GROUP BY 1, 2""")
def q02(spark, sf):
    return explore.class_histogram(v.survey(spark, sf), "grade", [0, 1, 2, 3, 4, 5])


@query("q03_value_counts_missing", f"WITH {v.RAW} SELECT coalesce(nullif(label_text, ''), '<missing>') AS value, count(*) AS records FROM raw GROUP BY 1")
def q03(spark, sf):
    return profile.value_counts(v.raw(spark, sf), "label_text", blanks=True)


RAW_TEXT = ["label_text", "size_text", "log_text", "date_text"]


@query("q04_missingness", f"WITH {v.RAW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 9) AS fraction FROM raw" for c in RAW_TEXT))
def q04(spark, sf):
    return profile.missingness(v.raw(spark, sf), RAW_TEXT)


_BLANK = r"\s*"


@query("q05_table_profile", f"WITH {v.RAW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'string' AS type, count(*) FILTER (WHERE {c} IS NULL OR regexp_full_match({c}, '{_BLANK}')) AS missing, count(DISTINCT {c}) FILTER (WHERE NOT regexp_full_match({c}, '{_BLANK}')) AS \"distinct\" FROM raw" for c in RAW_TEXT))
def q05(spark, sf):
    return profile.table_profile(v.raw(spark, sf), RAW_TEXT)


def _coordinate_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {key}la, lo"
    return f"""WITH {v.SITES}, n AS (SELECT *, {v.OK} AS ok, count(*) OVER ({over}) AS n FROM sites)
  SELECT {key}count(*) FILTER (WHERE la IS NOT NULL AND lo IS NOT NULL) AS present, count(*) FILTER (WHERE la IS NULL OR lo IS NULL) AS missing,
  count(*) FILTER (WHERE la IS NOT NULL AND lo IS NOT NULL AND NOT ok) AS invalid, count(*) FILTER (WHERE ok) AS valid, count(DISTINCT (la, lo)) FILTER (WHERE ok) AS unique_valid,
  count(*) FILTER (WHERE ok AND n > 1) AS duplicate_rows, min(la) FILTER (WHERE ok) AS lat_min, max(la) FILTER (WHERE ok) AS lat_max,
  min(lo) FILTER (WHERE ok) AS lon_min, max(lo) FILTER (WHERE ok) AS lon_max FROM n {group}"""


@query("q06_coordinate_profile", _coordinate_sql(""))
def q06(spark, sf):
    return profile.coordinate_profile(v.sites(spark, sf), "la", "lo")


@query("q07_coordinates_by_event", _coordinate_sql("event"))
def q07(spark, sf):
    return profile.coordinate_profile(v.sites(spark, sf), "la", "lo", by="event")


@query("q08_geographic_coverage", f"""WITH {v.SITES}, s AS (SELECT *, {v.OK} AS ok, CASE label WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS grade FROM sites)
  SELECT city, count(*) AS records, count(*) FILTER (WHERE ok) AS valid_records, count(DISTINCT (la, lo)) FILTER (WHERE ok) AS unique_pairs, count(grade) AS known_damage,
  min(la) FILTER (WHERE ok) AS lat_min, max(la) FILTER (WHERE ok) AS lat_max, min(lo) FILTER (WHERE ok) AS lon_min, max(lo) FILTER (WHERE ok) AS lon_max,
  round(median(la) FILTER (WHERE ok), 9) AS lat_median, round(median(lo) FILTER (WHERE ok), 9) AS lon_median, round(avg(la) FILTER (WHERE ok), 9) AS lat_mean FROM s GROUP BY city""")
def q08(spark, sf):
    df = canonical.native_damage(v.sites(spark, sf), "label", v.SEGMENTS)
    return explore.geographic_coverage(df, "city", "la", "lo", "damage_ordinal_native")


FIELDS = [
    canonical.Field("label_text", "label"), canonical.Field("size_text", "size", "number"),
    canonical.Field("log_text", "intensity", "log", "g", "exponential of the source value"), canonical.Field("date_text", "surveyed", "date"),
]


def _canonical(spark, sf):
    return canonical.canonicalize(v.raw(spark, sf), FIELDS, "id", "label", v.TYPES)


_GRADE = "CASE " + v.stripped("label_text") + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in v.TYPES.items()) + " END"
_DATE = "try_cast(" + v.stripped("date_text") + " AS TIMESTAMP)"


@query("q09_canonicalize", f"""WITH {v.RAW} SELECT id, {v.stripped('label_text')} AS label, {v.number('size_text')} AS size, round(exp({v.number('log_text')}), 9) AS intensity,
  CAST({_DATE} AS VARCHAR) AS surveyed, {_GRADE} AS damage_grade, label_text AS raw__label_text, size_text AS raw__size_text, log_text AS raw__log_text, date_text AS raw__date_text FROM raw""")
def q09(spark, sf):
    df = _canonical(spark, sf).drop("issues")
    return df.withColumns({"intensity": F.round("intensity", 9), "surveyed": F.date_format("surveyed", "yyyy-MM-dd HH:mm:ss")})


def _issue(field: str, source: str, kind: str, bad: str) -> str:
    return f"SELECT id, '{field}' AS field, '{kind}' AS kind, {source} AS raw_value FROM raw WHERE {v.stripped(source)} IS NOT NULL AND ({bad}) IS NULL"


@query("q10_issues", f"WITH {v.RAW} " + " UNION ALL ".join([
    _issue("size", "size_text", "numeric_parse_error", v.number("size_text")), _issue("intensity", "log_text", "numeric_parse_error", v.number("log_text")),
    _issue("surveyed", "date_text", "date_parse_error", _DATE), _issue("label", "label_text", "unmapped_damage_label", _GRADE)]))
def q10(spark, sf):
    return canonical.issue_rows(_canonical(spark, sf), "id")


def _rule(field: str, rule: str, bad: str) -> str:
    return f"SELECT id, '{field}' AS field, '{rule}' AS rule, round({field}, 6) AS value FROM checked WHERE {bad}"


RULES = " UNION ALL ".join([
    _rule("latitude", "latitude_range", "latitude NOT BETWEEN -90 AND 90"), _rule("longitude", "longitude_range", "longitude NOT BETWEEN -180 AND 180"), _rule("latitude", "zero_pair", "latitude = 0 AND longitude = 0"),
    _rule("floors", "whole_number_from_1", "floors % 1 <> 0 OR floors < 1"), _rule("basement", "whole_number_from_0", "basement % 1 <> 0 OR basement < 0"),
    _rule("mmi", "between_1_and_12", "mmi NOT BETWEEN 1 AND 12"), _rule("area", "positive", "area <= 0"), _rule("basement", "not_negative", "basement < 0")])


def _violations(spark, sf):
    rules = [*quality.coordinate_rules("latitude", "longitude"), quality.whole_number("floors", 1), quality.whole_number("basement", 0), quality.number_range("mmi", 1, 12), quality.positive("area"), quality.not_negative("basement")]
    return quality.violations(v.checked(spark, sf), "id", rules)


@query("q11_quality_violations", f"WITH {v.CHECKED} {RULES}")
def q11(spark, sf):
    return _violations(spark, sf)


@query("q11b_quality_counts", f"WITH {v.CHECKED}, f AS ({RULES}) SELECT field, rule, count(*) AS records FROM f GROUP BY 1, 2")
def q11b(spark, sf):
    return quality.quality_counts(_violations(spark, sf))


@query("q12_duplicate_groups", """WITH l AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
  c AS (SELECT o_custkey, o_orderstatus, string_agg(o_orderpriority || '=' || CAST(n AS VARCHAR), '|' ORDER BY o_orderpriority) AS label_counts FROM l GROUP BY 1, 2)
  SELECT o_custkey, o_orderstatus, count(*) AS size, count(DISTINCT o_orderpriority) AS labels, any_value(label_counts) AS label_counts, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS members
  FROM orders JOIN c USING (o_custkey, o_orderstatus) GROUP BY 1, 2 HAVING count(*) > 1""")
def q12(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("record", F.col("o_orderkey"))
    return profile.duplicate_groups(orders, ["o_custkey", "o_orderstatus"], "record", "o_orderpriority", "o_orderkey")


@query("q13_repeated_rows", """WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1)
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS repeated_rows, count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM g""")
def q13(spark, sf):
    return profile.repeated_rows(v.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


_SEGMENT = h._case("label", v.SEGMENTS)


@query("q14_label_mapping", f"""WITH {v.SITES} SELECT id, label AS damage_native, {_SEGMENT} AS damage_ordinal_native, 'provisional_not_for_pooling' AS damage_mapping_status,
  CAST({_SEGMENT} >= 3 AS INTEGER) AS high_damage_candidate FROM sites""")
def q14(spark, sf):
    df = canonical.native_damage(v.sites(spark, sf), "label", v.SEGMENTS, candidate_from=3)
    return df.select("id", "damage_native", "damage_ordinal_native", "damage_mapping_status", "high_damage_candidate")


@query("q15_unmapped_labels", f"WITH {v.SITES} SELECT label AS damage_native, count(*) AS records FROM sites WHERE {_SEGMENT} IS NULL GROUP BY 1")
def q15(spark, sf):
    df = canonical.native_damage(v.sites(spark, sf), "label", v.SEGMENTS)
    return df.where("damage_native is not null and damage_ordinal_native is null").groupBy("damage_native").agg(F.count(F.lit(1)).alias("records"))


@query("q16_harmonize_a", f"WITH {h.A} SELECT * REPLACE (round(\"PGA\", 9) AS \"PGA\") FROM a")
def q16(spark, sf):
    return h.survey_a(spark, sf).withColumn("PGA", F.round("PGA", 9))


@query("q17_harmonize_b", f"WITH {h.B} SELECT * FROM b")
def q17(spark, sf):
    return h.stations_b(spark, sf)


@query("q18_harmonize_c", f"WITH {h.C} SELECT * FROM c")
def q18(spark, sf):
    return h.census_c(spark, sf)


def _all(spark, sf):
    return h.survey_a(spark, sf).unionByName(h.stations_b(spark, sf)).unionByName(h.census_c(spark, sf))


_UNION = f"WITH {h.A}, {h.B}, {h.C}, u AS (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b UNION ALL BY NAME SELECT * FROM c)"
_RULES = {
    "missing_required": " OR ".join(f"{c} IS NULL" for c in harmonize.REQUIRED), "bad_hash": "NOT regexp_full_match(source_sha256, '[a-f0-9]{64}')",
    "candidate_not_provisional": "high_damage_candidate IS NOT NULL AND damage_mapping_status IS DISTINCT FROM 'provisional_not_for_pooling'", "candidate_forbidden": "dataset_id = 'stations_b' AND high_damage_candidate IS NOT NULL",
    "ordinal_forbidden": "dataset_id = 'survey_a' AND (damage_ordinal_native IS NOT NULL OR high_damage_candidate IS NOT NULL)",
    "ordinal_range": "damage_ordinal_native NOT BETWEEN CASE WHEN dataset_id = 'census_c' THEN 1 ELSE 0 END AND 4",
}


@query("q19_schema_violations", _UNION + " " + " UNION ALL ".join(f"SELECT dataset_id, '{k}' AS rule, count(*) FILTER (WHERE {w}) AS records FROM u GROUP BY 1" for k, w in _RULES.items()) + """
  UNION ALL SELECT dataset_id, 'repeated_record_id', count(*) - count(DISTINCT record_id) FROM u GROUP BY 1""")
def q19(spark, sf):
    """Rules set stricter than the sources are, so that some fire."""
    return harmonize.record_violations(_all(spark, sf), {"census_c": (1, 4)}, no_candidate=("stations_b",), no_ordinal=("survey_a",))


_MAPS = ["event_id", "city", "damage_native", "damage_ordinal_native", "coordinate_status"]


@query("q20_dataset_card", _UNION + """ SELECT 'records' AS item, 'all' AS key, count(*) AS records FROM u
  UNION ALL SELECT 'unmapped_label', 'all', count(*) FILTER (WHERE damage_native IS NOT NULL AND damage_ordinal_native IS NULL) FROM u
  UNION ALL SELECT 'floors', 'present', count(floors) FROM u UNION ALL SELECT 'floors', 'nonpositive', count(*) FILTER (WHERE floors <= 0) FROM u UNION ALL SELECT 'floors', 'fractional', count(*) FILTER (WHERE floors % 1 <> 0) FROM u
  UNION ALL SELECT 'intensity', 'PGA', count("PGA") FROM u UNION ALL SELECT 'intensity', 'PGV', count("PGV") FROM u """ + " ".join(
    f"UNION ALL SELECT '{c}', coalesce(CAST({c} AS VARCHAR), '<missing>'), count(*) FROM u GROUP BY 2" for c in [*_MAPS, "source_sha256"]))
def q20(spark, sf):
    return profile.dataset_card(_all(spark, sf), _MAPS, "floors", ["PGA", "PGV"], "damage_native", "damage_ordinal_native", "source_sha256")


@query("q21_value_catalog", f"WITH {v.RAW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE abs({v.number(c)}) < 'Infinity'::DOUBLE) AS finite, count(*) FILTER (WHERE trim({c}) = 'NaN') AS literal_nan, count(*) FILTER (WHERE coalesce(trim({c}), '') = '') AS blank, count(*) AS records FROM raw" for c in RAW_TEXT))
def q21(spark, sf):
    return profile.value_catalog(v.raw(spark, sf), RAW_TEXT)


@query("q21b_literal_tokens", f"WITH {v.RAW}, t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM raw" for c in RAW_TEXT) + ") SELECT \"column\", count(*) AS records FROM t WHERE x = 'NaN' GROUP BY 1")
def q21b(spark, sf):
    return profile.literal_tokens(v.raw(spark, sf), RAW_TEXT)


_BASE = f"WITH RECURSIVE {v.SITES}, {v.STATIONS}"
_NEAR = f"near AS (SELECT a.id, b.station, {v.distance('a', 'b')} AS d FROM (SELECT * FROM sites WHERE {v.OK}) a, stations b WHERE abs(a.la - b.la) < 0.01 AND {v.distance('a', 'b')} <= 400)"


def _pairs(spark, sf):
    return proximity.pairs_within(v.sites(spark, sf), v.stations(spark, sf), "id", "station", "la", "lo", 400.0)


@query("q22_proximity_pairs", f"{_BASE}, {_NEAR} SELECT id, station, round(d, 3) AS distance FROM near")
def q22(spark, sf):
    return _pairs(spark, sf).withColumn("distance", F.round("distance", 3))


@query("q23_overlap_thresholds", f"""{_BASE}, {_NEAR} SELECT CAST(t AS DOUBLE) AS threshold, count(d) AS pairs, count(DISTINCT id) AS left_records, count(DISTINCT station) AS right_records
  FROM (VALUES (0), (150), (200), (300), (400)) x(t) LEFT JOIN near ON d <= t GROUP BY 1""")
def q23(spark, sf):
    return proximity.overlap_by_threshold(v.sites(spark, sf), v.stations(spark, sf), "id", "station", "la", "lo", [0, 150, 200, 300, 400])


@query("q24_nearest", f"{_BASE} SELECT a.id, round(min({v.distance('a', 'b')}), 3) AS distance FROM sites a, stations b WHERE {v.OK.replace('la', 'a.la').replace('lo ', 'a.lo ')} GROUP BY 1")
def q24(spark, sf):
    return proximity.nearest(v.sites(spark, sf), v.stations(spark, sf), "id", "station", "la", "lo", 500.0).withColumn("distance", F.round("distance", 3))


@query("q25_proximity_groups", f"""{_BASE}, ok AS (SELECT CAST(id AS VARCHAR) AS id, la, lo FROM sites WHERE {v.OK}), points AS (SELECT la, lo, min(id) AS point FROM ok GROUP BY 1, 2),
  e AS (SELECT a.point AS x, b.point AS y FROM points a, points b WHERE abs(a.la - b.la) < 0.01 AND {v.distance('a', 'b')} <= 400),
  reach AS (SELECT point AS x, point AS y FROM points UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x), root AS (SELECT x AS point, min(y) AS root FROM reach GROUP BY 1),
  each AS (SELECT CAST(s.id AS VARCHAR) AS id, coalesce(r.root, CAST(s.id AS VARCHAR)) AS root FROM sites s LEFT JOIN points p ON p.la = s.la AND p.lo = s.lo LEFT JOIN root r ON r.point = p.point),
  names AS (SELECT root, 'site_' || substr(sha256(string_agg(id, '|' ORDER BY id)), 1, 20) AS site FROM each GROUP BY 1)
  SELECT id, site FROM each JOIN names USING (root)""")
def q25(spark, sf):
    return proximity.proximity_groups(v.sites(spark, sf), "id", "la", "lo", 400.0)


@query("q26_box_gaps", f"""WITH {v.SITES}, m AS (SELECT event, min(la) AS x0, max(la) AS x1, min(lo) AS y0, max(lo) AS y1 FROM (SELECT event, la + length(event) AS la, lo + length(event) AS lo FROM sites WHERE {v.OK}) t GROUP BY 1)
  SELECT a.event AS "first", b.event AS "second", round(sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)), 9) AS gap FROM m a JOIN m b ON a.event < b.event""")
def q26(spark, sf):
    away = F.length("event")
    moved = v.sites(spark, sf).where(valid_coordinates(F.col("la"), F.col("lo"))).select("event", (F.col("la") + away).alias("x"), (F.col("lo") + away).alias("y"))
    return proximity.box_gaps(moved, "event", "x", "y").withColumn("gap", F.round("gap", 9))


def _utm_sql() -> str:
    c = "CAST(0.08181919084262149 AS DOUBLE)"
    east = " + ".join(f"CAST({a!r} AS DOUBLE) * cos({2 * j} * x) * sinh({2 * j} * e)" for j, a in enumerate((0.0008377318188192541, 7.608496958699166e-07, 1.2034877875966646e-09), 1))
    north = east.replace("cos(", "sin(").replace("sinh(", "cosh(")
    return f"""t1 AS (SELECT id, la, lo, sinh(atanh(sin(radians(la))) - {c} * atanh({c} * sin(radians(la)))) AS t, radians(lo - 39) AS l FROM sites WHERE {v.OK}),
  t2 AS (SELECT *, atan(t / cos(l)) AS x, atanh(sin(l) / sqrt(1 + t * t)) AS e FROM t1), k AS (SELECT CAST(0.9996 AS DOUBLE) * CAST(6367449.145823415 AS DOUBLE) AS k),
  utm AS (SELECT id, 500000 + k * (e + {east}) AS east, k * (x + {north}) AS north FROM t2, k)"""


@query("q27_utm_cells", f"""WITH {v.SITES}, {_utm_sql()} SELECT s.id, round(east, 4) AS east, round(north, 4) AS north,
  CASE WHEN u.id IS NULL THEN 'invalid_coordinate' ELSE 'utm37_5km_' || CAST(CAST(floor(east / 5000) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(north / 5000) AS BIGINT) AS VARCHAR) END AS cell FROM sites s LEFT JOIN utm u ON s.id = u.id""")
def q27(spark, sf):
    east, north = utm37(F.col("la"), F.col("lo"))
    ok = valid_coordinates(F.col("la"), F.col("lo"))
    return v.sites(spark, sf).select("id", F.when(ok, F.round(east, 4)).alias("east"), F.when(ok, F.round(north, 4)).alias("north"), grid_cell(F.col("la"), F.col("lo")).alias("cell"))


COLUMNS = design.Columns("record", "domain", "grp", "event", "la", "lo", "label", "ordinal")
DOMAINS = [f"d{k}" for k in range(10)]
_ELIGIBLE = f"""{v.DESIGN}, el AS (SELECT *, {v.OK} AS ok FROM design),
  clash AS (SELECT la, lo FROM el WHERE ok GROUP BY 1, 2 HAVING count(DISTINCT label) > 1),
  eligible AS (SELECT *, CASE WHEN ok AND (la, lo) IN (SELECT (la, lo) FROM clash) THEN 'conflicting_labels_at_exact_coordinate' WHEN ordinal IS NULL THEN 'missing_or_unmapped_native_damage' ELSE '' END AS reason FROM el)"""


@query("q28_eligibility", f"WITH {_ELIGIBLE} SELECT record, reason FROM eligible")
def q28(spark, sf):
    return design.eligibility(v.design(spark, sf), COLUMNS, conflicts=True).select("record", "reason")


def _folds_sql(folds: list[design.Fold]) -> str:
    values = ", ".join(f"('{f.name}', '{f.test}', '{f.validation}')" for f in folds)
    return f"""{_ELIGIBLE}, folds AS (SELECT * FROM (VALUES {values}) t(fold, test, validation)),
  r AS (SELECT fold, record, grp, event, la, lo, ok, label, CASE WHEN domain IS NULL THEN 'missing_domain' WHEN NOT ok THEN 'missing_or_invalid_coordinate' ELSE reason END AS reason,
    CASE WHEN domain = test THEN 'test' WHEN domain = validation THEN 'validation' ELSE 'train' END AS role FROM eligible, folds),
  x AS (SELECT *, CASE WHEN grp IS NOT NULL AND min(role) OVER g <> max(role) OVER g THEN 'group_crosses_domain_partition' ELSE reason END AS why FROM r WINDOW g AS (PARTITION BY fold, grp)),
  y AS (SELECT *, CASE WHEN why <> '' THEN 'excluded' ELSE role END AS part FROM x),
  parts AS (SELECT fold, record AS record_id, part AS "partition", why AS exclusion_reason, grp AS leakage_group,
    CASE WHEN part = 'excluded' THEN CAST(0 AS DOUBLE) WHEN NOT ok THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / count(*) FILTER (WHERE part <> 'excluded') OVER (PARTITION BY fold, event, la, lo) END AS evaluation_weight,
    grp AS uncertainty_group, label FROM y)"""


ONE = [design.Fold("one", "d3", "d7")]
ALL = design.cyclic_folds(DOMAINS, {"d4": "d9"})


def _parts(spark, sf, folds):
    return design.partition_folds(v.design(spark, sf), COLUMNS, folds, coordinate_required=True)


@query("q29_partition_fold", f"WITH {_folds_sql(ONE)} SELECT * EXCLUDE (label) REPLACE (round(evaluation_weight, 9) AS evaluation_weight) FROM parts")
def q29(spark, sf):
    return _parts(spark, sf, ONE).withColumn("evaluation_weight", F.round("evaluation_weight", 9))


@query("q30_all_folds", f"WITH {_folds_sql(ALL)} SELECT * EXCLUDE (label) REPLACE (round(evaluation_weight, 9) AS evaluation_weight) FROM parts")
def q30(spark, sf):
    return _parts(spark, sf, ALL).withColumn("evaluation_weight", F.round("evaluation_weight", 9))


@query("q31_fold_summary", f"""WITH {_folds_sql(ALL)}, roles AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test'), ('excluded')) t(p)),
  c AS (SELECT f.fold, p AS "partition", count(record_id) AS records, count(DISTINCT leakage_group) AS groups, round(coalesce(sum(evaluation_weight), 0), 6) AS weight
    FROM folds f CROSS JOIN roles LEFT JOIN parts ON parts.fold = f.fold AND parts."partition" = p GROUP BY 1, 2)
  SELECT *, "partition" <> 'excluded' AND records = 0 AS "empty", "partition" IN ('validation', 'test') AND records < 30 AS "small" FROM c""")
def q31(spark, sf):
    return design.fold_summary(_counts(spark, sf))


def _counts(spark, sf):
    return design.fold_counts(v.design(spark, sf), COLUMNS, ALL, coordinate_required=True)


@query("q31b_fold_classes", f"""WITH {_folds_sql(ALL)} SELECT fold, "partition" AS item, coalesce(label, '<missing>') AS key, count(*) AS records FROM parts GROUP BY ALL
  UNION ALL SELECT fold, 'exclusions', exclusion_reason, count(*) FROM parts WHERE "partition" = 'excluded' GROUP BY ALL""")
def q31b(spark, sf):
    return design.fold_classes(_counts(spark, sf))


@query("q32_disjoint_violations", f"""WITH {_folds_sql(ALL)} SELECT fold, count(*) FILTER (WHERE "partition" = 'excluded' AND evaluation_weight <> 0) AS weighed_exclusions, count(*) - count(DISTINCT record_id) AS repeated_records,
  (SELECT count(*) FROM (SELECT leakage_group FROM parts q WHERE q.fold = parts.fold AND q."partition" <> 'excluded' GROUP BY 1 HAVING count(DISTINCT q."partition") > 1)) AS split_groups FROM parts GROUP BY fold""")
def q32(spark, sf):
    return design.violations_of(design.prepare(v.design(spark, sf), COLUMNS, ALL, coordinate_required=True), ALL)


@query("q33_reserved_external", """SELECT s_suppkey AS record_id, 'reserved_external' AS "partition", false AS evaluation_enabled, s_nationkey * 7 IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS linked FROM supplier""")
def q33(spark, sf):
    external = v.table(spark, sf, "supplier").withColumn("grp", F.col("s_nationkey") * 7)
    return design.reserve_external(external, "s_suppkey", "grp", v.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("q34_reconciliation", """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey <> 3 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, a.n AS left_value, b.n AS right_value, a.n IS NOT DISTINCT FROM b.n AS "equal" FROM a FULL JOIN b ON a.k = b.k""")
def q34(spark, sf):
    a = v.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = v.table(spark, sf, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.reconcile(a, b, "k", "n")


@query("q35_domain_drift", """SELECT DISTINCT o_orderstatus AS value, 'unexpected' AS side FROM orders WHERE o_orderstatus NOT IN ('F', 'X') UNION ALL
  SELECT x, 'absent' FROM (VALUES ('F'), ('X')) t(x) WHERE x NOT IN (SELECT o_orderstatus FROM orders)""")
def q35(spark, sf):
    return reconcile.domain_drift(v.table(spark, sf, "orders"), "o_orderstatus", ["F", "X"])


@query("q36_histogram", f"""WITH {v.SURVEY}, u AS (SELECT price AS x FROM survey WHERE price > 0), m AS (SELECT min(x) AS lo, max(x) AS hi FROM u)
  SELECT least(CAST(floor((x - lo) * 24 / (hi - lo)) AS INTEGER) + 1, 24) AS bin, count(*) AS records FROM u, m GROUP BY 1""")
def q36(spark, sf):
    return explore.histogram(v.survey(spark, sf), "price")


@query("q37_box_statistics", f"""WITH {v.SURVEY}, u AS (SELECT grade, price AS x FROM survey WHERE price > 0 AND grade IS NOT NULL),
  q AS (SELECT grade, count(*) AS records, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS q3 FROM u GROUP BY 1)
  SELECT q.grade, records, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS high
  FROM u JOIN q ON u.grade = q.grade GROUP BY q.grade, records, q1, md, q3""")
def q37(spark, sf):
    return explore.box_statistics(v.survey(spark, sf).where("grade is not null"), "grade", "price")


@query("q38_intensity_accounting", f"WITH {v.SURVEY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, count(*) FILTER (WHERE {c} > 0) AS used, count(*) - count({c}) AS missing, count(*) FILTER (WHERE {c} <= 0) AS invalid, min({c}) FILTER (WHERE {c} > 0) AS least, max({c}) AS largest FROM survey" for c in ("price", "discount")))
def q38(spark, sf):
    return explore.intensity_accounting(v.survey(spark, sf), ["price", "discount"])


@query("q39_html", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
  len(regexp_extract_all(html, '(?is)<li>\s*<a href="(.*?)">(.*?)</a>', 1)) AS pairs,
  array_to_string(list_transform(regexp_extract_all(html, '(?is)<li>\s*<a href="(.*?)">(.*?)</a>', 2), lambda x: trim(x)), '|') AS words FROM pages""")
def q39(spark, sf):
    pairs = html_pairs(F.col("html"), r'(?is)<li>\s*<a href="(.*?)">(.*?)</a>')
    return v.table(spark, sf, "pages").select("page_id", html_title(F.col("html")).alias("title"), F.size(pairs).cast("long").alias("pairs"), F.array_join(pairs["value"], "|").alias("words"))


@query("q40_preferred_product", "SELECT user_id, arg_max(event_id, (value, ts, event_id)) AS chosen FROM events GROUP BY 1")
def q40(spark, sf):
    return preferred(v.table(spark, sf, "events"), "user_id", F.col("value"), F.struct("ts", "event_id"), F.col("event_id"))


@query("q41_json_properties", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS records FROM events GROUP BY 1, 2")
def q41(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return v.table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("records"))


@query("q42_nearest_both_sides", f"""{_BASE}, p AS (SELECT a.id, b.station, {v.distance('a', 'b')} AS d FROM (SELECT * FROM sites WHERE {v.OK}) a, stations b), l AS (SELECT min(d) AS d FROM p GROUP BY id), r AS (SELECT min(d) AS d FROM p GROUP BY station)
  SELECT 'sites' AS side, count(*) AS records, round(min(d), 3) AS least, round(max(d), 3) AS largest FROM l UNION ALL SELECT 'stations', count(*), round(min(d), 3), round(max(d), 3) FROM r""")
def q42(spark, sf):
    a, b = v.sites(spark, sf), v.stations(spark, sf)
    sides = {"sites": proximity.nearest(a, b, "id", "station", "la", "lo", 500.0), "stations": proximity.nearest(b, a, "station", "id", "la", "lo", 500.0)}
    rows = [d.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("records"), F.round(F.min("distance"), 3).alias("least"), F.round(F.max("distance"), 3).alias("largest")) for n, d in sides.items()]
    return rows[0].unionByName(rows[1])


@query("q43_block_statistics", """WITH p AS (SELECT c_nationkey AS block, CASE WHEN c_custkey % 9 = 0 THEN -1 ELSE CAST(floor(abs(c_acctbal)) AS INTEGER) % 256 END AS value FROM customer)
  SELECT block, count(*) FILTER (WHERE value <> -1) AS valid, count(*) FILTER (WHERE value = -1) AS masked, min(value) FILTER (WHERE value <> -1) AS least, max(value) FILTER (WHERE value <> -1) AS largest,
  count(DISTINCT value) FILTER (WHERE value <> -1) AS levels FROM p GROUP BY 1""")
def q43(spark, sf):
    value = F.when(F.col("c_custkey") % 9 == 0, -1).otherwise(F.floor(F.abs("c_acctbal")).cast("int") % 256)
    pixels = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("block"), value.alias("value"))
    return explore.block_statistics(pixels, "block", "value", -1).withColumn("levels", F.size("histogram").cast("long")).drop("histogram")


_DEG = "CAST(0.02 AS DOUBLE)"


@query("q44_points_in_regions", f"""WITH {v.SITES}, {v.STATIONS} SELECT station, count(DISTINCT id) AS sites, min(id) AS first FROM (SELECT * FROM sites WHERE {v.OK}) s JOIN
  (SELECT station, la AS y0, la + {_DEG} * (1 + station % 5) AS y1, lo AS x0, lo + {_DEG} * (1 + station % 3) AS x1 FROM stations) p ON s.la BETWEEN y0 AND y1 AND s.lo BETWEEN x0 AND x1 GROUP BY 1""")
def q44(spark, sf):
    """Boxes north-east of the stations, as polygons of one ring."""
    s = v.stations(spark, sf).withColumns({"y": F.col("la") + F.lit(0.02) * (1 + F.col("station") % 5), "x": F.col("lo") + F.lit(0.02) * (1 + F.col("station") % 3)})
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = s.select("station", F.array(F.array(corner("lo", "la"), corner("x", "la"), corner("x", "y"), corner("lo", "y"))).alias("rings"))
    points = v.sites(spark, sf).where(valid_coordinates(F.col("la"), F.col("lo")))
    return proximity.points_by_polygon(points, boxes, "id", "station", "lo", "la", "rings").withColumnRenamed("points", "sites")


@query("q45_duplicate_names", "SELECT c_name AS name, count(*) AS count FROM (SELECT substr(c_name, 1, 17) AS c_name FROM customer UNION ALL SELECT substr(s_name, 1, 17) FROM supplier) t WHERE c_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q45(spark, sf):
    """Names without their last digit, so that some repeat."""
    c, s = v.table(spark, sf, "customer"), v.table(spark, sf, "supplier")
    return profile.duplicate_names(c.select(F.substring("c_name", 1, 17).alias("name")).unionByName(s.select(F.substring("s_name", 1, 17).alias("name"))), "name")


@query("q46_cell_text", """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * 1000 AS VARCHAR) AS price, CAST(l_discount / 8 AS VARCHAR) AS discount, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped,
  CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END AS large FROM lineitem WHERE l_linenumber = 1""")
def q46(spark, sf):
    df = v.table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000).alias("price"), (F.col("l_discount") / 8).alias("discount"), F.col("l_shipdate").alias("shipped"), (F.col("l_quantity") > 25).alias("large"))
    return df.select("l_orderkey", "l_linenumber", *[cell_text(df, c).alias(c) for c in ("price", "discount", "shipped", "large")])


@query("q47_strict_numbers", f"WITH {v.RAW} SELECT id, {v.number('size_text')} AS size FROM raw WHERE id % 13 <> 0")
def q47(spark, sf):
    return v.raw(spark, sf).where("id % 13 <> 0").select("id", strict_double(F.col("size_text")).alias("size"))


@query("q48_training_domains", f"WITH {v.DESIGN}, f(test, validation) AS (VALUES " + ", ".join(f"('{f.test}', '{f.validation}')" for f in ALL) + "), d AS (SELECT DISTINCT domain FROM design WHERE domain IS NOT NULL) SELECT 'fold_' || test AS fold, domain FROM f, d WHERE domain NOT IN (test, validation)")
def q48(spark, sf):
    return design.domain_complement(v.design(spark, sf), "domain", ALL)


@query("q49_png_headers", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 70000 AS BIGINT) END AS width, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS height, CASE WHEN p_partkey % 5 <> 0 THEN 8 END AS depth FROM part")
def q49(spark, sf):
    """Headers made of keys and sizes; each fifth isn't a PNG's."""
    mark = F.when(F.col("p_partkey") % 5 != 0, "89504E470D0A1A0A").otherwise("25504446FFFFFFFF")
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(mark, F.lit("0000000D49484452"), word(F.col("p_partkey") % 70000), word(F.col("p_size")), F.lit("0802000000")))
    found = v.table(spark, sf, "part").select("p_partkey", png_header(head).alias("h"))
    return found.select("p_partkey", "h.width", "h.height", F.col("h.bit_depth").cast("int").alias("depth"))


_MEMBER = "CASE o_orderkey % 7 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'C:' WHEN 3 THEN 'a/../' WHEN 4 THEN 'a..b/' WHEN 5 THEN 'd\\' ELSE 'ok/' END"


@query("q50_unsafe_members", f"SELECT o_orderkey, {_MEMBER} || CAST(o_orderkey AS VARCHAR) AS member, o_orderkey % 7 NOT IN (4, 6) AS unsafe FROM orders")
def q50(spark, sf):
    k = F.col("o_orderkey") % 7
    lead = F.when(k == 0, "../").when(k == 1, "/").when(k == 2, "C:").when(k == 3, "a/../").when(k == 4, "a..b/").when(k == 5, "d\\").otherwise("ok/")
    return v.table(spark, sf, "orders").select("o_orderkey", F.concat(lead, F.col("o_orderkey").cast("string")).alias("member")).withColumn("unsafe", unsafe_member(F.col("member")))


@query("q51_sidecar_digests", """WITH d AS (SELECT source, printf('%09d.txt', doc_id) AS name, sha256(text) AS digest FROM documents WHERE lang = 'en')
  SELECT source, sha256('{' || string_agg('"' || name || '": "' || digest || '"', ', ' ORDER BY name) || '}') AS sidecar_sha256 FROM d GROUP BY 1""")
def q51(spark, sf):
    docs = v.table(spark, sf, "documents").where("lang = 'en'").select("source", F.concat(numbered("%09d", F.col("doc_id")), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").alias("length"))
    return sidecar_hash(digests(docs).join(docs.select(F.col("path").alias("name"), "source"), "name"), "source", "name", "sha256")


@query("q52_file_checks", """WITH s AS (SELECT printf('s%d', s_suppkey) AS name, s_suppkey AS k, s_name AS body FROM supplier)
  SELECT name, CASE WHEN k % 10 > 1 THEN length(body) END AS bytes,
  CASE WHEN k % 10 = 0 THEN 'missing' WHEN k % 10 = 1 THEN 'optional_missing' WHEN k % 10 = 2 THEN 'too_small' WHEN k % 10 = 3 THEN 'wrong_size' WHEN k % 10 = 4 THEN 'wrong_digest' WHEN k % 10 = 5 THEN 'wrong_format' ELSE 'ok' END AS status FROM s""")
def q52(spark, sf):
    s = v.table(spark, sf, "supplier").select(F.format_string("s%d", "s_suppkey").alias("name"), (F.col("s_suppkey") % 10).alias("k"), "s_name")
    content = F.encode("s_name", "UTF-8")
    files = s.where("k > 1").select(F.concat(F.lit("store/"), "name").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    k, size = F.col("k"), F.octet_length("s_name").cast("long")
    expected = s.select("name", F.when(k == 2, size + 1).otherwise(1).alias("least_bytes"), F.when(k == 3, size + 2).when(k > 5, size).alias("exact_bytes"), F.when(k == 4, F.md5(F.lit("x"))).when(k == 6, F.upper(F.md5("s_name"))).alias("md5"),
                        F.when(k == 5, "pdf").when(k == 7, "unknown").alias("format"), (k != 1).alias("required"))
    return check_files(files, expected)


_SNIFF = {"%PDF-1.7": "pdf", "<x a='1'/>": "markup", "a,b": "csv", "[1, 2]": "json", "[1, 2": "csv", "none": "unknown"}


@query("q53_formats", "SELECT n_nationkey, CASE n_nationkey % 6 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(_SNIFF.values())) + " END AS format FROM nation")
def q53(spark, sf):
    head = F.array(*[F.lit(x) for x in _SNIFF])[(F.col("n_nationkey") % 6).cast("int")]
    return v.table(spark, sf, "nation").select("n_nationkey", sniff(F.encode(head, "UTF-8")).alias("format"))


_ROWS = """(SELECT p_partkey + 1 AS source_row, printf('part_r%04d', p_partkey + CASE WHEN p_partkey % 101 = 0 THEN 2 ELSE 1 END) AS record, p_type AS label, p_brand AS structure, p_partkey AS k FROM part)"""
_GRADES = {"ECONOMY": 0, "SMALL": 1, "MEDIUM": 2}
_GRADE_SQL = h._case("label", _GRADES)


@query("q54_table_violations", f"""WITH t AS (SELECT CASE WHEN k % 211 = 0 THEN 1 ELSE source_row END AS source_row, CASE WHEN k % 97 = 0 THEN NULL ELSE record END AS record, label, structure,
    CASE WHEN k % 50 = 0 THEN 9 ELSE {_GRADE_SQL} END AS grade, k % 43 <> 0 AND ({_GRADE_SQL}) IS NOT NULL AS flag FROM {_ROWS} p)
  SELECT 'null_record' AS rule, count(*) FILTER (WHERE record IS NULL) AS records FROM t UNION ALL SELECT 'null_row', count(*) FILTER (WHERE source_row IS NULL) FROM t UNION ALL
  SELECT 'row_before_first', count(*) FILTER (WHERE source_row < 2) FROM t UNION ALL SELECT 'record_is_not_its_row', count(*) FILTER (WHERE record IS DISTINCT FROM printf('part_r%04d', source_row)) FROM t UNION ALL
  SELECT 'grade_is_not_its_label', count(*) FILTER (WHERE grade IS DISTINCT FROM ({_GRADE_SQL})) FROM t UNION ALL SELECT 'flag_is_wrong', count(*) FILTER (WHERE flag IS DISTINCT FROM (grade IS NOT NULL)) FROM t UNION ALL
  SELECT 'repeated_record', count(record) - count(DISTINCT record) FROM t UNION ALL SELECT 'repeated_row', count(source_row) - count(DISTINCT source_row) FROM t""")
def q54(spark, sf):
    k = F.col("p_partkey")
    grade = lookup(F.col("p_type"), _GRADES)
    t = v.table(spark, sf, "part").select(
        F.when(k % 211 == 0, 1).otherwise(k + 1).alias("source_row"), F.when(k % 97 != 0, numbered("part_r%04d", k + F.when(k % 101 == 0, 2).otherwise(1))).alias("record"),
        F.col("p_type").alias("label"), F.col("p_brand").alias("structure"), F.when(k % 50 == 0, 9).otherwise(grade).alias("grade"), ((k % 43 != 0) & grade.isNotNull()).alias("flag"))
    return canonical.table_violations(t, "record", "source_row", "part_r%04d", "label", "grade", _GRADES, "structure", "flag")


@query("q55_ranked_counts", "SELECT row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place, o_orderpriority AS value, count(*) AS records FROM orders GROUP BY 2")
def q55(spark, sf):
    return profile.ranked_counts(v.table(spark, sf, "orders"), "o_orderpriority")


@query("q56_text_parts", """SELECT o_orderkey, CASE WHEN starts_with(o_clerk, 'H:') THEN substr(o_clerk, 3) ELSE o_clerk END AS bare, CASE WHEN n < 0 THEN '-' || lpad(CAST(-n AS VARCHAR), CAST(greatest(6, length(CAST(-n AS VARCHAR))) AS INTEGER), '0') ELSE lpad(CAST(n AS VARCHAR), CAST(greatest(7, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END AS filled
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'H:' ELSE 'G:' END || CAST(o_custkey AS VARCHAR) AS o_clerk, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS n FROM orders) t""")
def q56(spark, sf):
    key = F.col("o_orderkey")
    lead = F.concat(F.when(key % 2 == 0, "H:").otherwise("G:"), F.col("o_custkey").cast("string"))
    return v.table(spark, sf, "orders").select("o_orderkey", without_prefix(lead, "H:").alias("bare"), zero_filled(F.when(key % 3 == 0, -key).otherwise(key), 7).alias("filled"))
