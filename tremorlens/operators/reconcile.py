"""Comparisons of two tables or of a table with a declared list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left_value, right_value, equal; keys of either side (nulls match)."""
    a = left.select(F.col(key).alias("_a"), F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(F.col(key).alias("_b"), F.col(value).alias("right_value"))
    joined = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    return joined.select(F.when(F.col("_l").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(key), "left_value", "right_value", F.col("left_value").eqNullSafe(F.col("right_value")).alias("equal"))


def domain_drift(df: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """value, side (unexpected or absent) of values that only the table or only the declared list has."""
    spark = df.sparkSession
    want = spark.createDataFrame([(d,) for d in declared], "value string")
    have = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return have.join(F.broadcast(want), "value", "left_anti").withColumn("side", F.lit("unexpected")).unionByName(want.join(have, "value", "left_anti").withColumn("side", F.lit("absent")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
