"""Three sources in the harmonized schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lookup, numbered
from ..operators.canonical import native_damage
from ..operators.harmonize import DEFAULTS, TYPES, encoded_floors, harmonize
from . import views as v

HASH = "a" * 64
SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}


def _damage() -> dict:
    return {c: F.col(c) for c in ("damage_native", "damage_ordinal_native", "damage_mapping_status", "high_damage_candidate")}


def survey_a(spark: SparkSession, sf: str) -> DataFrame:
    df = native_damage(v.sites(spark, sf), "label", v.SEGMENTS, candidate_from=3)
    values = {"event_id": F.col("event"), "city": F.col("city"), "source_row": F.col("id"), "source_id_native": F.col("id"),
              "latitude": F.col("la"), "longitude": F.col("lo"), "floors": F.col("id") % 6 + F.when(F.col("id") % 19 == 0, 0.5).otherwise(0.0), "PGA": F.abs("balance") / 10000, "author_supplemented": F.col("id") % 41 == 0}
    return harmonize(df, "survey_a", "a.csv", HASH, values | _damage(), license="CC-BY-4.0")


def stations_b(spark: SparkSession, sf: str) -> DataFrame:
    s = v.table(spark, sf, "supplier")
    la, lo = v.place(F.col("s_suppkey"))
    damage = F.element_at(F.array(*[F.lit(x) for x in ("N", "L", "M", "S", "C", "R", "")]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    df = native_damage(s.withColumns({"label": damage, "la": la, "lo": lo}), "label", {"N": 0, "L": 1, "M": 2, "S": 3, "C": 4}, candidate_from=3)
    values = {"record_id": numbered("stations_b_%d", F.col("s_suppkey")), "source_row": F.col("s_suppkey") + 3, "event_id": F.when(F.col("s_suppkey") % 7 != 3, "event_b"), "latitude": F.col("la"), "longitude": F.col("lo"),
              "country": lookup(F.col("s_nationkey"), {0: "Zero", 1: "One"}), "PGV": F.col("s_acctbal")}
    return harmonize(df, "stations_b", "b.csv", HASH, values | _damage())


def census_c(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").withColumn("f", F.concat(F.lit("H:"), v.text(F.col("o_orderkey") % 4 + 1)))
    df = native_damage(o.withColumn("label", F.concat(F.lit("Grade "), F.substring("o_orderpriority", 1, 1))), "label", {f"Grade {k}": k for k in range(1, 6)})
    values = {"event_id": F.lit("event_c"), "coordinate_method": F.lit("administrative_codes_only"), "source_row": F.col("o_orderkey"), "admin1": F.col("o_orderstatus"), "floors_native": F.col("f"), "floors": encoded_floors(F.col("f"))[0]}
    return harmonize(df, "census_c", "c.csv", HASH, values | _damage())


def _sql(name: str, dataset: str, source: str, values: dict[str, str], origin: str) -> str:
    given = {k: f"'{x}'" for k, x in DEFAULTS.items()} | {
        "dataset_id": f"'{dataset}'", "source_path": f"'{source}'", "source_sha256": f"'{HASH}'", "source_row_unit": "'data row, 1-based'", "damage_scale": f"'{dataset}_native'"} | values
    columns = ", ".join(f'CAST({given.get(c, "NULL")} AS {SQL_TYPES[t]}) AS "{c}"' for c, t in TYPES.items() if c != "coordinate_status")
    status = "CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing' WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) THEN 'valid_range_only' ELSE 'invalid' END"
    return f"{name} AS (SELECT *, {status} AS coordinate_status FROM (SELECT {columns} FROM {origin}) t)"


def _damage_sql(native: str, ordinal: str, candidate: bool) -> dict[str, str]:
    return {"damage_native": native, "damage_ordinal_native": ordinal, "damage_mapping_status": "'provisional_not_for_pooling'" if candidate else "'native_only'"} | (
        {"high_damage_candidate": f"CAST(({ordinal}) >= 3 AS INTEGER)"} if candidate else {})


def _case(c: str, table: dict[str, int]) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in table.items()) + " END)"


A = v.SITES + ", " + _sql("a", "survey_a", "a.csv", {
    "record_id": "printf('survey_a_r%07d', id)", "license": "'CC-BY-4.0'", "event_id": "event", "city": "city", "source_row": "id", "source_id_native": "id", "latitude": "la", "longitude": "lo",
    "floors": "id % 6 + CASE WHEN id % 19 = 0 THEN 0.5 ELSE 0 END", "PGA": "abs(balance) / 10000", "author_supplemented": "id % 41 = 0"} | _damage_sql("label", _case("label", v.SEGMENTS), True), "sites")
_B = "(SELECT *, nullif(list_extract(['N', 'L', 'M', 'S', 'C', 'R', ''], CAST(s_suppkey % 7 + 1 AS INTEGER)), '') AS label FROM supplier) s"
B = _sql("b", "stations_b", "b.csv", {
    "record_id": "printf('stations_b_%d', s_suppkey)", "source_row": "s_suppkey + 3", "event_id": "CASE WHEN s_suppkey % 7 <> 3 THEN 'event_b' END", "latitude": "37 + (s_suppkey * 7919 % 1000) / CAST(2000 AS DOUBLE)", "longitude": "36 + (s_suppkey * 104729 % 1000) / CAST(2000 AS DOUBLE)",
    "country": "CASE s_nationkey WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' END", "PGV": "s_acctbal"} | _damage_sql("label", _case("label", {"N": 0, "L": 1, "M": 2, "S": 3, "C": 4}), True), _B)
_C = "(SELECT *, 'Grade ' || substr(o_orderpriority, 1, 1) AS label, 'H:' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS f FROM orders) o"
C = _sql("c", "census_c", "c.csv", {
    "record_id": "printf('census_c_r%07d', o_orderkey)", "event_id": "'event_c'", "coordinate_method": "'administrative_codes_only'", "source_row": "o_orderkey", "admin1": "o_orderstatus", "floors_native": "f", "floors": "CAST(substr(f, 3) AS DOUBLE)"}
    | _damage_sql("label", _case("label", {f"Grade {k}": k for k in range(1, 6)}), False), _C)
