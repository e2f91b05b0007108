"""Aggregates that hold at any size: many columns in one pass, exact quantiles without gathering a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import materialize

#: Bins of the first pass over a group, and rows of a group whose values one task may count.
BINS, COUNTED = 4096, 1 << 20


def per_column(df: DataFrame, columns: list[str], measures: dict[str, Callable[[Column], Column]], name: str = "column") -> DataFrame:
    """A row for each column with aggregates of it. One pass over the table and one row out of it; rows are not
    multiplied by columns."""
    sums = df.agg(*[m(F.col(c)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, m in measures.items()])
    rows = [F.struct(F.lit(c).alias(name), *[F.col(f"{i}_{k}").alias(k) for k in measures]) for i, c in enumerate(columns)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grouped_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """g, x of all rows with a value, written once for the passes of exact_quantiles."""
    return materialize(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")))


def exact_quantiles(df: DataFrame, group: str, value: str, probabilities: dict[str, float], counted: int = COUNTED) -> DataFrame:
    """group and one column for each named probability: exact, interpolated between the two nearest ranks. Nulls are left
    out; values must be finite."""
    return quantiles_of(grouped_values(df, group, value), probabilities, counted).withColumnRenamed("g", group)


def quantiles_of(rows: DataFrame, probabilities: dict[str, float], counted: int = COUNTED) -> DataFrame:
    """exact_quantiles of rows (g, x) that are written already.

    Groups of at most `counted` rows count their values in one task. If any is larger, equal-width bins are counted in
    each group, which tells the bins that the wanted ranks fall in, and then only the values of these bins are told
    apart, so no task holds the values of a group.
    """
    ends = rows.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    ends = materialize(ends)
    if (ends.agg(F.max("n")).first()[0] or 0) <= counted:
        found = rows.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probabilities.values()])).alias("q"))
        return found.select("g", *[F.col("q")[k].alias(n) for k, n in enumerate(probabilities)])
    # A row for each group; the join is left to the size of these.
    same = F.col("g").eqNullSafe(F.col("k"))
    share = F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    placed = rows.join(ends.withColumnRenamed("g", "k"), same).select("g", "x", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probabilities.items()])).alias("q")
    wanted = ends.select("g", "n", at).select(F.col("g").alias("k"), "q.name", (F.col("q.p") * (F.col("n") - 1)).alias("rank"))
    wanted = wanted.select("k", "name", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("r"))
    hit = counts.join(wanted, F.col("g").eqNullSafe(F.col("k")) & (F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("c"))).select("k", "bin", "before", "name", "rank", "r")
    bins = hit.select("k", F.col("bin").alias("b"), "before").distinct()
    values = placed.join(bins, F.col("g").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b"))).groupBy("g", "bin", "before", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("g", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("last", F.col("before") + F.sum("c").over(upto)).select("g", F.col("bin").alias("vb"), "x", "c", "last")
    found = hit.join(values, F.col("k").eqNullSafe(F.col("g")) & (F.col("bin") == F.col("vb")) & (F.col("r") < F.col("last")) & (F.col("r") >= F.col("last") - F.col("c")))
    ranks = found.groupBy("k", "name", "rank").agg(F.min_by("x", "r").alias("a"), F.max_by("x", "r").alias("b"))
    each = ranks.select("k", "name", (F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))).alias("x"))
    return each.groupBy(F.col("k").alias("g")).agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in probabilities])
