"""Profiles of tables whose meaning isn't known yet, and dataset cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinates
from ..functions.text import blank_as_missing, fractional, missing_word, safe_double
from .running import numbered_rows
from .summaries import per_column


def value_counts(df: DataFrame, column: str, blanks: bool = False) -> DataFrame:
    """Rows of each value; null (with blanks, the empty text too) counts as <missing>."""
    word = blank_as_missing(F.col(column)) if blanks else missing_word(F.col(column))
    return df.groupBy(word.alias("value")).agg(F.count(F.lit(1)).alias("records"))


def ranked_counts(df: DataFrame, column: str) -> DataFrame:
    """place (from 1, by rows, then value), value, records: value_counts in order, of any number of values."""
    return numbered_rows(value_counts(df, column), [F.desc("records"), F.col("value")], "place").select("place", "value", "records")


def counts_map(df: DataFrame, column: str) -> DataFrame:
    """value_counts as one key-sorted map, for reports of bounded vocabularies."""
    return value_counts(df, column).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "records")))).alias("counts"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column and their share, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = sums.unpivot(["_n"], columns, "column", "missing")
    return long.select("column", "missing", F.round(F.try_divide(F.col("missing").cast("double"), F.col("_n")), 9).alias("fraction"))


def table_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: type, missing (null or white space only), distinct values (untrimmed) among the others."""
    kinds = dict(df.dtypes)
    named = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    empty = F.col("v").isNull() | F.col("v").rlike(r"(?U)\A\s*\z")
    # Two steps: values are counted before they are told apart, so a column of one value costs one row a task.
    values = named.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy("column").agg(F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("missing"), F.count_if(~empty).alias("distinct"))
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return out.select("column", kind[F.col("column")].alias("type"), "missing", "distinct")


def coordinate_profile(df: DataFrame, lat: str, lon: str, by: str | None = None) -> DataFrame:
    """Present, missing, invalid and valid pairs, distinct valid pairs, rows that share one, bounds; for all or per group."""
    keys = [by] if by else []
    la, lo = F.col(lat), F.col(lon)
    ok = valid_coordinates(la, lo)
    pairs = df.groupBy(*keys, la.alias("la"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    ok, both = valid_coordinates(F.col("la"), F.col("lo")), F.col("la").isNotNull() & F.col("lo").isNotNull()
    n = F.col("n")

    def rows(when):
        return F.coalesce(F.sum(F.when(when, n).otherwise(0)), F.lit(0))

    return pairs.groupBy(*keys).agg(
        rows(both).alias("present"), rows(~both).alias("missing"), rows(both & ~ok).alias("invalid"), rows(ok).alias("valid"),
        F.count_if(ok).alias("unique_valid"), rows(ok & (n > 1)).alias("duplicate_rows"),
        *[f(F.when(ok, F.col(c))).alias(a) for f, c, a in ((F.min, "la", "lat_min"), (F.max, "la", "lat_max"), (F.min, "lo", "lon_min"), (F.max, "lo", "lon_max"))])


def duplicate_groups(df: DataFrame, keys: list[str], member: str, label: str, order: str) -> DataFrame:
    """Groups of more than one row: keys, size, distinct labels, label_counts (label=rows, missing included, by label),
    members in order; both joined."""
    labels = df.groupBy(*keys, missing_word(F.col(label)).alias("_word")).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(order, member)).alias("_m"))
    counts = F.array_sort(F.collect_list(F.struct("_word", "_n")))
    groups = labels.groupBy(*keys).agg(F.sum("_n").alias("size"), F.count_if(F.col("_word") != "<missing>").alias("labels"), counts.alias("_c"), F.array_sort(F.flatten(F.collect_list("_m"))).alias("_m"))
    return groups.where("size > 1").select(
        *keys, "size", "labels", F.array_join(F.transform("_c", lambda c: F.concat_ws("=", c["_word"], c["_n"].cast("string"))), "|").alias("label_counts"),
        F.array_join(F.transform("_m", lambda s: s[member].cast("string")), "|").alias("members"))


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows in groups of more than one, number of such groups, rows after the first of each group; nulls are equal."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_rows"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """name, count of the names in a column (such as the header cells of many sheets) that occur more than once."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).count().where("count > 1")


def value_catalog(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: finite numbers, literal NaN, blanks, rows."""
    def text(c):
        return F.trim(c.cast("string"))

    def number(c):
        return safe_double(c.cast("string"))

    return per_column(df, columns, {
        "finite": lambda c: F.count_if(F.abs(number(c)) < F.lit(float("inf"))), "literal_nan": lambda c: F.count_if(text(c) == "NaN"),
        "blank": lambda c: F.count_if(F.coalesce(text(c), F.lit("")) == ""), "records": lambda _: F.count(F.lit(1))})


def literal_tokens(df: DataFrame, columns: list[str], token: str = "NaN") -> DataFrame:
    """Columns that hold the token, with the number of rows."""
    return per_column(df, columns, {"records": lambda c: F.count_if(c.cast("string") == token)}).where("records > 0")


def dataset_card(df: DataFrame, maps: list[str], floors: str, intensities: list[str], label: str, ordinal: str, digest: str) -> DataFrame:
    """Long table (item, key, records) of a harmonized table: size, value counts, unmapped labels, odd floors, intensities,
    and the digests of its sources."""
    def count(item: str, key: str, when):
        return F.struct(F.lit(item).alias("item"), F.lit(key).alias("key"), F.count_if(when).alias("records"))

    whole = F.array(
        count("records", "all", F.lit(True)), count("unmapped_label", "all", F.col(label).isNotNull() & F.col(ordinal).isNull()),
        count("floors", "present", F.col(floors).isNotNull()), count("floors", "nonpositive", F.col(floors) <= 0), count("floors", "fractional", fractional(F.col(floors))),
        *[count("intensity", c, F.col(c).isNotNull()) for c in intensities])
    one = df.agg(whole.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    maps = [*maps, digest]
    long = df.select(*[missing_word(F.col(c)).alias(c) for c in maps]).unpivot([], maps, "item", "key")
    return one.unionByName(long.groupBy("item", "key").agg(F.count(F.lit(1)).alias("records")))
