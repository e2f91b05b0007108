"""Descriptive aggregates: rates, coverage, histograms and box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinates
from ..functions.text import finite, missing_word, usable_intensity
from .summaries import exact_quantiles, grouped_values, per_column, quantiles_of


def damage_rates(df: DataFrame, structure: str, grade: str) -> DataFrame:
    """Per structure: total, known, missing, damaged (1 and up), severe (3 and up), rate of damaged among known or null."""
    g = F.col(grade)
    out = df.groupBy(missing_word(F.col(structure)).alias("structure")).agg(
        F.count(F.lit(1)).alias("total"), F.count(g).alias("known"), F.count_if(g.isNull()).alias("missing"),
        F.count_if(g >= 1).alias("damaged"), F.count_if(g >= 3).alias("severe"))
    return out.withColumn("damage_rate", F.round(F.try_divide(F.col("damaged").cast("double"), F.col("known")), 9))


def geographic_coverage(df: DataFrame, city: str, lat: str, lon: str, grade: str) -> DataFrame:
    """Per city: rows, rows with valid coordinates, distinct pairs, known grades, bounds, medians and mean latitude."""
    ok = valid_coordinates(F.col(lat), F.col(lon))
    la, lo = F.when(ok, F.col(lat)), F.when(ok, F.col(lon))
    sums = df.groupBy(F.col(city).alias("city")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("valid_records"), F.count_distinct(F.when(ok, F.struct(lat, lon))).alias("unique_pairs"),
        F.count(grade).alias("known_damage"), F.min(la).alias("lat_min"), F.max(la).alias("lat_max"), F.min(lo).alias("lon_min"), F.max(lo).alias("lon_max"), F.round(F.avg(la), 9).alias("lat_mean"))
    axes = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).cast("double").alias("x")) for n, c in (("lat_median", lat), ("lon_median", lon))])).alias("a")
    points = df.where(ok).select(F.col(city).alias("at"), axes).select(F.struct("at", "a.axis").alias("key"), "a.x")
    middle = exact_quantiles(points, "key", "x", {"m": 0.5}).groupBy("key.at").agg(*[F.round(F.max(F.when(F.col("key.axis") == n, F.col("m"))), 9).alias(n) for n in ("lat_median", "lon_median")])
    return sums.join(middle, F.col("city").eqNullSafe(F.col("at")), "left").drop("at")


def class_histogram(df: DataFrame, grade: str, classes: list[int]) -> DataFrame:
    """Count of each class in order, classes without rows included, missing last."""
    spark = df.sparkSession
    order = spark.createDataFrame([(k, str(c)) for k, c in enumerate(classes)] + [(len(classes), "NA")], "position int, class string")
    found = df.groupBy(F.coalesce(F.col(grade).cast("string"), F.lit("NA")).alias("class")).count()
    return F.broadcast(order).join(found, "class", "left").select("position", "class", F.coalesce("count", F.lit(0)).alias("records"))


def histogram(df: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Equal-width bins over usable values; the largest value is in the last bin. Bounds come from one aggregate."""
    x = F.col(column).cast("double")
    usable = df.where(usable_intensity(x)).select(x.alias("x"))
    low, high = usable.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return usable.select(F.lit(1).alias("bin"), F.lit(0).cast("long").alias("records")).limit(0)
    place = F.lit(1) if low == high else F.least(F.width_bucket("x", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    return usable.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("records"))


def box_statistics(df: DataFrame, group: str, column: str, reach: float = 1.5) -> DataFrame:
    """Quartiles per group and the outermost values within reach of the quartile range; exact, interpolated."""
    x = F.col(column).cast("double")
    usable = grouped_values(df.where(usable_intensity(x)), group, column)
    q = quantiles_of(usable, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("g", "grade")
    span = reach * (F.col("q3") - F.col("q1"))
    # One row a group on the right; the largest and least within reach and the rows are found in one pass.
    ends = usable.join(q, F.col("grade").eqNullSafe(F.col("g"))).groupBy("grade", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("records"), F.min(F.when(F.col("x") >= F.col("q1") - span, F.col("x"))).alias("low"), F.max(F.when(F.col("x") <= F.col("q3") + span, F.col("x"))).alias("high"))
    return ends.select("grade", "records", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")])


def intensity_accounting(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: used (finite, positive), missing and invalid values, least and largest used."""
    def number(c):
        return c.cast("double")

    return per_column(df, columns, {
        "used": lambda c: F.count_if(usable_intensity(number(c))), "missing": lambda c: F.count_if(c.isNull()), "invalid": lambda c: F.count_if(c.isNotNull() & ~usable_intensity(number(c))),
        "least": lambda c: F.min(F.when(usable_intensity(number(c)), number(c))), "largest": lambda c: F.max(F.when(usable_intensity(number(c)), number(c)))}, "measure")


def block_statistics(df: DataFrame, block: str, value: str, nodata: float, bins: int = 256) -> DataFrame:
    """Per raster or block: valid and masked pixels, least, largest, and counts of the values 0 to bins - 1 as a map."""
    v = F.col(value)
    ok = finite(v.cast("double")) & (v != nodata)
    counts = df.where(ok & v.between(0, bins - 1)).groupBy(block, v.cast("int").alias("v")).count()
    maps = counts.groupBy(block).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "count")))).alias("histogram"))
    total = df.groupBy(block).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("masked"), F.min(F.when(ok, v)).alias("least"), F.max(F.when(ok, v)).alias("largest"))
    return total.join(maps, block, "left")
