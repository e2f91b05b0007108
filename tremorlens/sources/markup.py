"""Tables inside XML and HTML, and feed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ddi_variables(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """variable, files, label, category value, label, frequency, missing of a DDI codebook; with file only the variables of that data file."""
    schema = "_ID string, _name string, _files string, labl string, catgry array<struct<_missing:string, catValu:string, labl:string, catStat:string>>"
    rows = _ddi(spark, path, "var", schema)
    if file is not None:
        rows = rows.where(F.array_contains(F.split(F.trim("_files"), r"\s+"), file))
    each = rows.select(F.col("_name").alias("variable"), F.trim("labl").alias("label"), F.explode_outer("catgry").alias("c"))
    return each.select("variable", "label", F.trim("c.catValu").alias("value"), F.trim("c.labl").alias("category"), F.trim("c.catStat").try_cast("long").alias("frequency"), (F.col("c._missing") == "Y").alias("missing"))


def ddi_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its ID), name, rows and variables that a DDI codebook states for each data file."""
    rows = _ddi(spark, path, "fileDscr", "_ID string, fileTxt struct<fileName:string, dimensns:struct<caseQnty:string, varQnty:string>>")
    number = lambda c: F.trim(f"fileTxt.dimensns.{c}").try_cast("long")
    return rows.select(F.col("_ID").alias("file"), F.trim("fileTxt.fileName").alias("name"), number("caseQnty").alias("rows"), number("varQnty").alias("variables"))


def ddi_statistics(spark: SparkSession, path: str) -> DataFrame:
    """variable, type, value of the summary statistics of a DDI codebook."""
    rows = _ddi(spark, path, "var", "_name string, sumStat array<struct<_type:string, _VALUE:string>>")
    return rows.select(F.col("_name").alias("variable"), F.explode("sumStat").alias("s")).select("variable", F.col("s._type").alias("type"), F.trim("s._VALUE").alias("value"))


def _ddi(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


ROW = r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<t[dh][^>]*>(.*?)</t[dh]>"


def html_pairs(html: Column, row: str = ROW) -> Column:
    """Array of (key, value) with tags stripped: by default the first two cells of each table row."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    return F.zip_with(F.regexp_extract_all(html, F.lit(row), F.lit(1)), F.regexp_extract_all(html, F.lit(row), F.lit(2)), lambda k, v: F.struct(clean(k).alias("key"), clean(v).alias("value")))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def placemarks(kml: Column) -> Column:
    """Array of placemark names of a KML text."""
    return F.transform(F.regexp_extract_all(kml, F.lit(r"(?is)<Placemark[^>]*>.*?<name>(.*?)</name>"), 1), F.trim)


def ground_overlays(kml: Column) -> Column:
    """Array of north, south, east and west of the ground overlays of a KML text."""
    box = F.regexp_extract_all(kml, F.lit(r"(?is)<GroundOverlay\b.*?<LatLonBox[^>]*>(.*?)</LatLonBox>"), 1)
    side = lambda b, tag: F.regexp_extract(b, rf"(?is)<{tag}>\s*([^<]*?)\s*</{tag}>", 1).try_cast("double").alias(tag)
    return F.transform(box, lambda b: F.struct(*[side(b, t) for t in ("north", "south", "east", "west")]))


def placemark_tables(kml: Column) -> Column:
    """For each placemark of a KML text the pairs of its description's table rows of two cells."""
    marks = F.regexp_extract_all(kml, F.lit(r"(?is)<Placemark\b(.*?)</Placemark>"), 1)
    plain = lambda m: F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "&lt;", "<"), "&gt;", ">"), "&amp;", "&")
    return F.transform(marks, lambda m: html_pairs(plain(F.regexp_extract(m, r"(?is)<description>(.*?)</description>", 1))))


def preferred(df: DataFrame, group: str, weight: Column, updated: Column, value: Column) -> DataFrame:
    """group and the value of its row with the largest (weight, updated); a plain aggregate, so nothing is sorted."""
    return df.groupBy(group).agg(F.max_by(value, F.struct(weight, updated)).alias("chosen"))


def first_available(contents: Column, keys: list[str]) -> Column:
    """Value of the first key that a map has."""
    return F.coalesce(*[F.try_element_at(contents, F.lit(k)) for k in keys])
