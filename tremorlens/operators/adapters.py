"""Known sources in the harmonized schema, and what their tables must hold before they are read as records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup, numbered, strict_double
from ..sources.vectors import with_plane_interior_point
from .canonical import native_damage
from .harmonize import PROVISIONAL, assert_encoded, assert_records, encoded_floors, harmonize
from .validity import polygon_problems

# What the sources state about themselves, and their vocabularies.
SEQUENCE = "turkiye_syria_2023_sequence"
COHORT_EVENTS = {
    "Bingol earthquake engineering report": "bingol_2003",
    "Damage caused by the 1999 Duzce Earthquake in Turkey": "duzce_1999",
    "Damage caused by the 1992 Erzincan Earthquake": "erzincan_1992",
    "Measures of the seismic vulnerability of reinforced concrete buildings in Haiti": "haiti_2010",
    "Learning from the 2007 Pisco Peru earthquake": "pisco_2007",
    "Seismic vulnerability of reinforced concrete structures affected by the 2008 Wenchuan earthquake": "wenchuan_2008",
}
EVENT_COUNTRIES = {"bingol_2003": "TUR", "duzce_1999": "TUR", "erzincan_1992": "TUR", "pisco_2007": "PER", "haiti_2010": "HTI", "wenchuan_2008": "CHN"}
COHORT_DAMAGE = {"N": 0, "None": 0, "L": 1, "Light": 1, "M": 2, "Moderate": 2, "S": 3, "Severe": 3, "C": 4}
SITE_DAMAGE = {"N": 0, "L": 1, "M": 2, "S": 3, "C": 4}
CENSUS_DAMAGE = {f"Grade {k}": k for k in range(1, 6)}
INTENSITIES = ("PGA", "PGV", "SA_0p3", "SA_1p0")
CONTRACT = {"ordinals": {"nepal_geid": (1, 5)}, "no_candidate": ("nepal_geid",), "no_ordinal": ("spatial_this_study",)}


@dataclass(frozen=True)
class Source:
    """A source's name in the schema, its license, and the columns that are the same in all its records."""

    dataset: str
    license: str
    constants: tuple[tuple[str, str], ...]

    def records(self, df: DataFrame, path: str, sha256: str | Column, values: dict[str, Column], **more) -> DataFrame:
        return harmonize(df, self.dataset, path, sha256, {k: F.lit(v) for k, v in self.constants} | values, license=self.license, **more)


FIELD = ("label_provenance", "field_engineering_survey")
SURVEY = Source("turkiye_survey", "CC-BY-4.0", (
    FIELD, ("event_id", SEQUENCE), ("event_scope", "sequence_damage_not_single_shock"), ("country", "TUR"), ("damage_mapping_status", PROVISIONAL),
    ("im_status", "published_exp_log_medians_sequence_attribution_caveat"), ("im_source", "registered_survey_workbook_log_mean_columns"), ("im_transform", "exp(natural_log_mean); PGA_SA_g; PGV_cm_s")))
COHORT = Source("rc619", "CC-BY-SA-3.0", (FIELD, ("event_scope", "single_event"), ("structure_family", "RC_or_concrete_masonry_cohort_not_record_taxonomy")))
SITES = Source("aci133", "CC-BY-4.0", (
    ("label_provenance", "engineering_survey_with_author_supplementation"), ("event_id", SEQUENCE), ("event_scope", "sequence_damage_not_single_shock"), ("country", "TUR"),
    ("structure_family", "RC_cohort_not_record_taxonomy"), ("im_status", "source_columns_preserved_event_headers_unresolved"), ("im_source", "ACI133_physical_columns_c050_to_c106; consult_native_IM_catalog")))
CENSUS = Source("nepal_geid", "CC-BY-NC-SA-4.0; upstream NSO restrictions", (
    ("identity_status", "rounded_native_ID_use_source_row_only"), ("event_id", "gorkha_2015_sequence"), ("event_scope", "survey_after_mainshock_and_aftershocks"), ("country", "NPL"),
    ("label_provenance", "GEID_transformed_HRHRS_derived_survey"), ("structure_native", "see_source_11_multilabel_superstructure_flags"), ("coordinate_method", "administrative_codes_only_no_centroid_imputation")))
LAYERS = Source("spatial_this_study", "CC-BY-4.0 deposit; preserve upstream attribution", (
    ("event_id", SEQUENCE), ("event_scope", "sequence_damage_not_single_shock"), ("damage_mapping_status", "codebook_and_label_generation_unresolved"),
    ("label_provenance", "This_study_product_not_verified_independent_field_truth"), ("coordinate_method", "polygon_interior_point_UTM37N_to_WGS84"), ("im_status", "encoded_PGV_raster_not_physical_intensity")))


def _labels() -> dict[str, Column]:
    return {c: F.col(c) for c in ("damage_native", "damage_ordinal_native", "damage_mapping_status", "high_damage_candidate")}


def _same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def survey_records(df: DataFrame, path: str, sha256: str) -> DataFrame:
    """Canonical survey table (row: number of the record in its file, from 1) as records."""
    grade = F.col("damage_grade").cast("int")
    return SURVEY.records(df, path, sha256, _same("latitude", "longitude", "city", "floors", *INTENSITIES) | {
        "source_row": F.col("row"), "source_id_native": F.col("building_id"), "floors_native": F.col("floors").cast("string"), "structure_native": F.col("structure_type"),
        "structure_family": F.when(F.col("structure_type").startswith("RC "), "RC"), "damage_native": F.col("damage_label"), "damage_ordinal_native": grade, "high_damage_candidate": (grade >= 3).cast("int")})


def cohort_table(raw: DataFrame) -> DataFrame:
    """Raw cohort table (text cells; row: number of the record, from 1) with its typed columns. An unknown event, a repeated
    identifier or a number that doesn't parse is an error."""
    event = lookup(F.col("Case Name"), COHORT_EVENTS)
    if bad := raw.where(event.isNull()).select("Case Name").first():
        raise ValueError(f"unknown event: {bad[0]}")
    if bad := raw.groupBy("Experiment ID").count().where("count > 1").first():
        raise ValueError(f"repeated identifier: {bad[0]}")
    typed = {"latitude": "Latitude", "longitude": "Longitude", "floors": "No. \nFloors"}
    return raw.select(
        F.concat(F.lit("rc616_"), F.col("Experiment ID")).alias("building_id"), "row", event.alias("event_id"), F.col("Case ID").alias("source_case_id"),
        *[strict_double(F.col(f"`{c}`")).alias(n) for n, c in typed.items()], F.col("`Structural \nDamage`").alias("structural_damage_label"),
        lookup(F.col("`Structural \nDamage`"), COHORT_DAMAGE).cast("int").alias("structural_damage_ordinal"), *[F.col(f"`{c}`").alias(f"raw__{c}") for c in raw.columns if c != "row"])


def cohort_records(df: DataFrame, path: str, sha256: str) -> DataFrame:
    """cohort_table as records."""
    df = native_damage(df, "structural_damage_label", COHORT_DAMAGE, candidate_from=3)
    return COHORT.records(df, path, sha256, _same("latitude", "longitude", "floors", "event_id") | _labels() | {
        "source_row": F.col("row"), "source_id_native": F.col("building_id"), "country": lookup(F.col("event_id"), EVENT_COUNTRIES), "floors_native": F.col("`raw__No. \nFloors`")})


def site_records(sheet: DataFrame, path: str, sha256: str) -> DataFrame:
    """Sheet of site columns c001 and so on (row: number of the record, from 1; supplemented) as records. A repeated
    identifier or a label outside the vocabulary is an error."""
    if bad := sheet.where(lookup(F.col("c021"), SITE_DAMAGE).isNull()).select("c021").first():
        raise ValueError(f"unknown label: {bad[0]}")
    if bad := sheet.groupBy("c001").count().where("count > 1").first():
        raise ValueError(f"repeated identifier: {bad[0]}")
    df = native_damage(sheet, "c021", SITE_DAMAGE, candidate_from=3)
    return SITES.records(df, path, sha256, _labels() | {
        "source_row": F.col("row"), "source_id_native": F.concat(F.lit("aci133_"), F.col("c001")), "latitude": strict_double(F.col("c037")), "longitude": strict_double(F.col("c038")),
        "floors_native": F.col("c003"), "floors": strict_double(F.col("c003")), "author_supplemented": F.col("supplemented")})


def census_records(raw: DataFrame, path: str, sha256: str) -> DataFrame:
    """Raw census table (text cells; row: number of the record, from 1) as records. A count of floors encoded in another way is an error."""
    assert_encoded(raw, "BUILDING_FLOORS")
    df = native_damage(raw, "DAMAGE_GRADE", CENSUS_DAMAGE)
    return CENSUS.records(df, path, sha256, _labels() | {
        "source_row": F.col("row"), "source_id_native": F.col("BUILDING_ID"), "admin1": F.col("DISTRICT_ID"), "admin2": F.col("VDCMUN_ID"), "admin3": F.col("WARD_ID"),
        "floors_native": F.col("BUILDING_FLOORS"), "floors": encoded_floors(F.col("BUILDING_FLOORS"))[0]})


def layer_features(shapes: DataFrame, attributes: DataFrame, projection: str | None, city: str) -> DataFrame:
    """city, feature, damage_lev, point of a layer's shapes and attributes, as layer_records reads them.

    projection: the text beside the shapes that names their reference system; only WGS84 in degrees is known, a layer
    without it or with another is refused, as are shapes without geometry and invalid polygons. Points are found in the
    plane of zone 37 north.
    """
    text = (projection or "").replace(" ", "_").upper()
    if not (text.startswith("GEOGCS") and "WGS_1984" in text and "DEGREE" in text):
        raise ValueError("reference system is missing or not WGS84 in degrees")
    if n := shapes.where(F.size(F.flatten("rings")) <= 0).count():
        raise ValueError(f"{n} features without geometry")
    if bad := polygon_problems(shapes, "feature").orderBy("feature", "problem").first():
        raise ValueError(f"feature {bad['feature']}: {bad['problem']}")
    both = shapes.select("feature", "rings").join(attributes.select("feature", F.col("fields")["damage_lev"].alias("damage_lev")), "feature", "left")
    return with_plane_interior_point(both, "rings", "point").select(F.lit(city).alias("city"), "feature", "damage_lev", "point")


def layer_records(features: DataFrame, path: str, sha256: Column, abroad: dict[str, str] | None = None, country: str = "TUR") -> DataFrame:
    """Features (city, feature from 1, damage_lev, point: struct x, y inside the polygon) as records; sha256: that of a layer's
    files, by sources.tables.sidecar_hash. abroad: country of cities outside `country`. A feature without a point is an error."""
    if features.where(F.col("point").isNull()).limit(1).count():
        raise ValueError("geometries without an interior point")
    names = F.col("city")
    return LAYERS.records(features, path, sha256, {
        "record_id": numbered("spatial_this_study_%s_r%07d", names, F.col("feature")), "source_row": F.col("feature"), "source_id_native": F.col("feature").cast("string"), "city": names,
        "country": F.coalesce(lookup(names, abroad), F.lit(country)) if abroad else F.lit(country), "damage_native": F.col("damage_lev").cast("string"), "latitude": F.col("point.y"), "longitude": F.col("point.x"),
    }, row_unit="feature position, 1-based; SHA256 of sorted sidecar-hash JSON")


def assert_known_sources(df: DataFrame) -> None:
    """The record contract with the exceptions of the known sources."""
    assert_records(df, **CONTRACT)


def layer_inventory(shapes: DataFrame, attributes: DataFrame, most: int = 100) -> DataFrame:
    """path-free inventory of a layer's attributes: field, filled, distinct, and counts (value to rows) of fields of at most
    `most` values."""
    long = attributes.join(shapes.select("feature"), "feature").select(F.explode("fields").alias("field", "value"))
    values = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy("field").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("distinct"))
    few = values.join(sums.where(F.col("distinct") <= most).select("field"), "field").groupBy("field").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("value", F.lit("<missing>")).alias("value"), "n")))).alias("counts"))
    return sums.join(few, "field", "left")


def census_reconciliation(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """district_code, district_name, rows, official_rows, equal: rows of each district that the table has, against the
    frequencies that a codebook states (sources.markup.ddi_variables of the district variable)."""
    found = raw.groupBy(F.col("DISTRICT_ID").alias("district_code")).agg(F.count(F.lit(1)).alias("rows"))
    official = categories.select(F.col("value").alias("district_code"), F.col("category").alias("district_name"), F.col("frequency").alias("official_rows"))
    return found.join(official, "district_code", "left").select("district_code", "district_name", "rows", "official_rows", F.col("rows").eqNullSafe(F.col("official_rows")).alias("equal"))
