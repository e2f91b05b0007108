"""Base views over the driver's tables, once as DataFrames and once as SQL text for the oracle.

The tables hold no missing values, so these are put in by rules on the keys, the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = {"BUILDING": 0, "AUTOMOBILE": 1, "FURNITURE": 2, "MACHINERY": 3}
TYPES = {"ECONOMY": 0, "SMALL": 1, "MEDIUM": 2, "LARGE": 3, "PROMO": 4, "None": 0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: Column) -> Column:
    return c.cast("string")


def place(key: Column) -> tuple[Column, Column]:
    return 37 + (key * 7919 % 1000) / F.lit(2000.0), 36 + (key * 104729 % 1000) / F.lit(2000.0)


def grade_of(priority: Column) -> Column:
    return F.substring(priority, 1, 1).cast("int") - 1


def survey(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    missing = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 7 == 0)
    return joined.select(
        "l_orderkey", "l_linenumber", F.col("p_type").alias("structure"), F.col("o_orderpriority").alias("label"), F.when(~missing, grade_of(F.col("o_orderpriority"))).alias("grade"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice") - 2000).alias("price"), F.col("l_discount").alias("discount"))


SURVEY = """survey AS (SELECT l_orderkey, l_linenumber, p_type AS structure, o_orderpriority AS label,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 END AS grade,
  CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice - 2000 END AS price, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    la, lo = place(key)
    at = lambda x: F.when(key % 17 == 0, None).when(key % 23 == 0, F.lit(0.0)).otherwise(x)
    return joined.select(key.alias("id"), F.col("n_name").alias("city"), F.col("r_name").alias("event"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("balance"), at(la).alias("la"), at(lo).alias("lo"))


def _at(key: str, base: int, factor: int) -> str:
    return f"CASE WHEN {key} % 17 = 0 THEN NULL WHEN {key} % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE {base} + ({key} * {factor} % 1000) / CAST(2000 AS DOUBLE) END"


SITES = f"""sites AS (SELECT c_custkey AS id, n_name AS city, r_name AS event, c_mktsegment AS label, c_acctbal AS balance,
  {_at('c_custkey', 37, 7919)} AS la, {_at('c_custkey', 36, 104729)} AS lo
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
OK = "coalesce(la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0), false)"


def stations(spark: SparkSession, sf: str) -> DataFrame:
    la, lo = place(F.col("s_suppkey"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), (la + 0.0011).alias("la"), (lo + 0.0007).alias("lo"))


STATIONS = """stations AS (SELECT s_suppkey AS station, 37 + (s_suppkey * 7919 % 1000) / CAST(2000 AS DOUBLE) + CAST(0.0011 AS DOUBLE) AS la,
  36 + (s_suppkey * 104729 % 1000) / CAST(2000 AS DOUBLE) + CAST(0.0007 AS DOUBLE) AS lo FROM supplier)"""


def distance(a: str, b: str) -> str:
    """SQL of the haversine distance of two aliases with la and lo."""
    h = f"pow(sin((radians({b}.la) - radians({a}.la)) / 2), 2) + cos(radians({a}.la)) * cos(radians({b}.la)) * pow(sin(radians({b}.lo - {a}.lo) / 2), 2)"
    return f"(2 * CAST(6371008.8 AS DOUBLE) * asin(sqrt(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {h})))))"


def raw(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.when(k % 11 == 0, " None ").when(k % 11 == 1, "   ").when(k % 11 == 2, None).when(k % 11 == 3, "NA").otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit("  "))).alias("label_text"),
        F.when(k % 13 == 0, "not numeric").when(k % 13 == 1, "  ").when(k % 13 == 2, None).when(k % 13 == 3, F.concat(F.lit(" "), text(size), F.lit(".5 "))).otherwise(text(size)).alias("size_text"),
        F.when(k % 7 == 0, "NaN").otherwise(F.concat(F.lit("-"), text(size % 5), F.lit(".5"))).alias("log_text"),
        F.when(k % 5 == 0, "not a date").when(k % 5 == 1, None).otherwise(F.format_string("2023-02-%02d", k % 28 + 1)).alias("date_text"))


RAW = """raw AS (SELECT p_partkey AS id,
  CASE p_partkey % 11 WHEN 0 THEN ' None ' WHEN 1 THEN '   ' WHEN 2 THEN NULL WHEN 3 THEN 'NA' ELSE ' ' || p_type || '  ' END AS label_text,
  CASE p_partkey % 13 WHEN 0 THEN 'not numeric' WHEN 1 THEN '  ' WHEN 2 THEN NULL WHEN 3 THEN ' ' || CAST(p_size AS VARCHAR) || '.5 ' ELSE CAST(p_size AS VARCHAR) END AS size_text,
  CASE WHEN p_partkey % 7 = 0 THEN 'NaN' ELSE '-' || CAST(p_size % 5 AS VARCHAR) || '.5' END AS log_text,
  CASE p_partkey % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL ELSE '2023-02-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS date_text FROM part)"""
NUMBER = r"(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)"


def stripped(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({stripped(c)}, '{NUMBER}') THEN try_cast({stripped(c)} AS DOUBLE) END"


def checked(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 31 == 0, 95.0).when(k % 37 == 0, 0.0).otherwise(37.5).alias("latitude"), F.when(k % 37 == 0, 0.0).when(k % 41 == 0, -181.0).otherwise(36.0).alias("longitude"),
        F.when(k % 19 == 0, size + 0.5).when(k % 23 == 0, 0.0).otherwise(size.cast("double")).cast("double").alias("floors"), F.when(k % 43 == 0, -1.0).otherwise(0.0).alias("basement"),
        (size % 15).cast("double").alias("mmi"), (F.col("p_retailprice") - 1000).alias("area"))


CHECKED = """checked AS (SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 31 = 0 THEN 95 WHEN p_partkey % 37 = 0 THEN 0 ELSE 37.5 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN p_partkey % 37 = 0 THEN 0 WHEN p_partkey % 41 = 0 THEN -181 ELSE 36 END AS DOUBLE) AS longitude,
  CAST(CASE WHEN p_partkey % 19 = 0 THEN p_size + 0.5 WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS floors,
  CAST(CASE WHEN p_partkey % 43 = 0 THEN -1 ELSE 0 END AS DOUBLE) AS basement, CAST(p_size % 15 AS DOUBLE) AS mmi, p_retailprice - 1000 AS area FROM part)"""


def design(spark: SparkSession, sf: str) -> DataFrame:
    """Two native labels share ordinal 3, and some labels have none, so that conflicts of labels and of ordinals differ."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.when(k % 100 == 1, k - 1).otherwise(k)
    coordinate = lambda base, factor: F.when(k % 53 != 0, base + (at * factor % 100003) / F.lit(200000.0))
    return table(spark, sf, "orders").select(
        k.alias("record"), F.when(c % 97 != 0, F.concat(F.lit("d"), text(c % 10))).alias("domain"),
        F.when(c % 49 == 0, F.concat(F.lit("g"), text(c % 7))).otherwise(F.concat(F.lit("c"), text(c))).alias("grp"), F.col("o_orderstatus").alias("event"),
        coordinate(37, 7919).alias("la"), coordinate(36, 104729).alias("lo"), F.when(k % 37 != 0, F.col("o_orderpriority")).alias("label"),
        F.when((k % 31 != 0) & (k % 37 != 0), F.least(grade_of(F.col("o_orderpriority")), F.lit(3))).alias("ordinal"))


DESIGN = """design AS (SELECT o_orderkey AS record, CASE WHEN o_custkey % 97 <> 0 THEN 'd' || CAST(o_custkey % 10 AS VARCHAR) END AS domain,
  CASE WHEN o_custkey % 49 = 0 THEN 'g' || CAST(o_custkey % 7 AS VARCHAR) ELSE 'c' || CAST(o_custkey AS VARCHAR) END AS grp, o_orderstatus AS event,
  CASE WHEN o_orderkey % 53 <> 0 THEN 37 + ((o_orderkey - CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END) * 7919 % 100003) / CAST(200000 AS DOUBLE) END AS la,
  CASE WHEN o_orderkey % 53 <> 0 THEN 36 + ((o_orderkey - CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END) * 104729 % 100003) / CAST(200000 AS DOUBLE) END AS lo,
  CASE WHEN o_orderkey % 37 <> 0 THEN o_orderpriority END AS label,
  CASE WHEN o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 THEN least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, 3) END AS ordinal FROM orders)"""
