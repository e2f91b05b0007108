"""Text tables, previews and files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import materialize


def read_text_csv(spark: SparkSession, path: str, columns: list[str], lines: bool = False) -> DataFrame:
    """All columns as text; NA and None stay words, an empty cell is the empty text. The header must equal columns.

    lines: no cell holds a line break, so a file may be read in many tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, multiLine=not lines, quote='"', escape='"', enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.na.fill("")


def with_row_numbers(df: DataFrame, name: str = "row") -> DataFrame:
    """df, as a file reader gives it, with the number of each row in its file, from 1, in file order.

    Files are read in splits, in many tasks. A split's rows come in order, so a row's number is its place in the split
    and the sizes of the splits of its file before it: a row for each split is all that is added up. The rows are written
    once, so that every later read sees the same numbers. Header and dropped blank lines don't count, as the reader has them.
    """
    path, block, place = "_row_path", "_row_block", "_row_place"
    rows = materialize(df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(place)))
    splits = rows.groupBy(path, block).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select(F.col(path).alias("_of"), F.col(block).alias("_at"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    both = rows.join(starts, (F.col(path) == F.col("_of")) & (F.col(block) == F.col("_at")))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(place) + F.col("_shift")).alias(name))


def read_numbered_csv(spark: SparkSession, path: str, columns: list[str], lines: bool = False) -> DataFrame:
    """read_text_csv with `row`, the number of each record. lines: no cell holds a line break, so files may be read in splits."""
    return with_row_numbers(read_text_csv(spark, path, columns, lines))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def digests(files: DataFrame) -> DataFrame:
    """name, bytes, sha256 and md5 of each file."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def sidecar_hash(parts: DataFrame, group: str, name: str, digest: str) -> DataFrame:
    """One digest for each group of files: SHA-256 of the name-sorted JSON object of their digests."""
    entry = F.struct(F.col(name).alias("n"), F.col(digest).alias("d"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('"'), e["n"], F.lit('": "'), e["d"], F.lit('"'))), ", ")
    return parts.groupBy(group).agg(F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256).alias("sidecar_sha256"))


def check_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: name, least_bytes, exact_bytes, md5, format (of sniff, or null), required. Status of each: ok, missing,
    optional_missing, too_small, wrong_size, wrong_digest or wrong_format."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("_n"), F.col("length").alias("bytes"), F.md5("content").alias("_md5"), sniff(F.col("content")).alias("_format"))
    both = expected.join(have, F.col("name") == F.col("_n"), "left")
    status = (
        F.when(F.col("_n").isNull(), F.when(F.col("required"), "missing").otherwise("optional_missing"))
        .when(F.col("bytes") < F.coalesce("least_bytes", F.lit(0)), "too_small").when(F.col("bytes") != F.col("exact_bytes"), "wrong_size")
        .when(F.col("_md5") != F.lower("md5"), "wrong_digest").when(F.col("_format") != F.col("format"), "wrong_format").otherwise("ok"))
    return both.select("name", "bytes", status.alias("status"))


def assert_files(statuses: DataFrame) -> None:
    """Raise if a required file is missing or any file isn't as expected."""
    bad = statuses.where(~F.col("status").isin("ok", "optional_missing")).orderBy("name").collect()
    if bad:
        raise ValueError("; ".join(f"{r.name}: {r.status}" for r in bad))


def sniff(content: Column) -> Column:
    """Format of a file: pdf, zip, png, markup, csv or unknown by its first bytes; json if all of it parses."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    lead = F.ltrim(head)
    return (
        F.when(head.startswith("%PDF"), "pdf").when(head.startswith("PK\x03\x04"), "zip").when(head.startswith("\x89PNG"), "png").when(lead.startswith("<"), "markup")
        .when((lead.startswith("{") | lead.startswith("[")) & F.try_parse_json(F.decode(content, "UTF-8")).isNotNull(), "json").when(F.instr(F.substring_index(head, "\n", 1), ",") > 0, "csv").otherwise("unknown"))
