"""Separate sources in one fixed record schema, native scales kept apart; one table for each source, never pooled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import valid_coordinates
from ..functions.text import full_match, numbered

# The harmonized schema, in order by type.
STRINGS = (
    "schema_version dataset_id record_id event_id event_scope country source_path source_sha256 source_row_unit source_id_native identity_status damage_native "
    "damage_scale damage_mapping_status label_provenance coordinate_status coordinate_method city admin1 admin2 admin3 floors_native floors_time_status "
    "structure_native structure_family im_status im_source im_transform im_event_id license"
).split()
DOUBLES = "latitude longitude floors PGA PGV SA_0p3 SA_1p0".split()
OTHERS = {"source_row": "long", "damage_ordinal_native": "int", "high_damage_candidate": "int", "author_supplemented": "boolean"}
TYPES = {c: "string" for c in STRINGS} | {c: "double" for c in DOUBLES} | OTHERS
SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if t == "double" else T.LongType() if t == "long" else T.IntegerType() if t == "int" else T.BooleanType() if t == "boolean" else T.StringType()) for c, t in TYPES.items()])
REQUIRED = ("record_id", "dataset_id", "source_path", "source_sha256", "source_row", "event_id", "damage_scale")
VERSION = "1d-v1"
PROVISIONAL, NATIVE_ONLY = "provisional_not_for_pooling", "native_only"
# What a record says unless its source says otherwise.
DEFAULTS = {
    "schema_version": VERSION, "identity_status": "source_record_not_verified_physical_building", "damage_mapping_status": NATIVE_ONLY,
    "floors_time_status": "reported_time_basis_unverified", "im_status": "not_present", "coordinate_method": "source_point",
}


def harmonize(df: DataFrame, dataset: str, source: str, sha256: str | Column, values: dict[str, Column], row_unit: str = "data row, 1-based", license: str | None = None) -> DataFrame:
    """A typed record for each row: the given columns, defaults and constants of the source, null elsewhere, and coordinate_status.

    Without a record_id the records are numbered by source_row.
    """
    unknown = set(values) - set(TYPES)
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    given = {k: F.lit(x) for k, x in DEFAULTS.items()} | {
        "dataset_id": F.lit(dataset), "source_path": F.lit(source), "source_sha256": F.lit(sha256) if isinstance(sha256, str) else sha256, "source_row_unit": F.lit(row_unit),
        "damage_scale": F.lit(f"{dataset}_native"), "license": F.lit(license),
    } | values
    if "record_id" not in given and "source_row" in given:
        given["record_id"] = numbered(f"{dataset}_r%07d", given["source_row"].cast("long"))
    out = df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in TYPES.items()])
    la, lo = F.col("latitude"), F.col("longitude")
    status = F.when(la.isNull() | lo.isNull(), "missing").when(valid_coordinates(la, lo), "valid_range_only").otherwise("invalid")
    return out.withColumn("coordinate_status", status)


def record_violations(df: DataFrame, ordinals: dict[str, tuple[int, int]] | None = None, no_candidate: tuple[str, ...] = (), no_ordinal: tuple[str, ...] = (), usual: tuple[int, int] = (0, 4)) -> DataFrame:
    """dataset_id, rule, records: breaches of the record contract, in one pass plus one over identifiers.

    ordinals: least and largest ordinal of datasets whose scale isn't the usual one.
    """
    d, o, h = F.col("dataset_id"), F.col("damage_ordinal_native"), F.col("high_damage_candidate")
    in_range = o.between(*usual)
    for name, (low, high) in (ordinals or {}).items():
        in_range = F.when(d == name, o.between(low, high)).otherwise(in_range)
    rules = {
        "missing_required": ~F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED]).eqNullSafe(0),
        "bad_hash": ~full_match(F.col("source_sha256"), "[a-f0-9]{64}"),
        "candidate_not_provisional": h.isNotNull() & ~F.col("damage_mapping_status").eqNullSafe(PROVISIONAL),
        "candidate_forbidden": d.isin(*no_candidate) & h.isNotNull() if no_candidate else F.lit(False),
        "ordinal_forbidden": d.isin(*no_ordinal) & (o.isNotNull() | h.isNotNull()) if no_ordinal else F.lit(False),
        "ordinal_range": o.isNotNull() & ~in_range,
    }
    each = df.groupBy("dataset_id").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in rules.items()])
    long = each.unpivot(["dataset_id"], list(rules), "rule", "records")
    repeated = df.groupBy("dataset_id", "record_id").count().groupBy("dataset_id").agg(F.sum(F.col("count") - 1).cast("long").alias("records")).select("dataset_id", F.lit("repeated_record_id").alias("rule"), "records")
    return long.unionByName(repeated)


def assert_records(df: DataFrame, **contract) -> None:
    """Raise unless df has the harmonized columns and types and breaks no rule of the record contract."""
    have = dict(df.dtypes)
    wrong = [c for c in TYPES if have.get(c) != SCHEMA[c].dataType.simpleString()] + [c for c in have if c not in TYPES]
    if wrong:
        raise ValueError(f"columns differ from the schema: {sorted(wrong)}")
    broken = record_violations(df, **contract).where("records > 0").orderBy("dataset_id", "rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r.dataset_id}: {r.rule} in {r.records} records" for r in broken))


def encoded_floors(c: Column) -> tuple[Column, Column]:
    """(floors, whether the text is not of the form H:n) of an encoded count."""
    ok = full_match(c, "H:[1-9][0-9]*")
    return F.when(ok, F.regexp_replace(c, "^H:", "").try_cast("double")), F.coalesce(~ok, F.lit(True))


def assert_encoded(df: DataFrame, column: str) -> None:
    """Raise if any encoded count has another form."""
    if bad := df.where(encoded_floors(F.col(column))[1]).count():
        raise ValueError(f"{bad} rows of {column} are encoded in another way")
