"""Operator 4: line dedup over hashes.

Line keys are hashed (SHA-256), the hashes are range-partitioned and sorted with document and position as
secondary order, and one streaming pass per hash finds the first occurrence (the document that keeps the line)
and the number of documents. What comes back is a bitmap of dropped lines for each document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, documents, heavy_keys, materialize, partitions, salted, sample_fraction

#: Bits in one bucket of Spark's bitmap functions.
BUCKET = 32_768


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    lines = base.select("_id", "_th", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    stripped = lines.withColumn("_line", F.btrim("_line", F.lit(BLANKS))).where(F.char_length("_line") >= min_chars)
    return stripped.select("_id", "_th", "_pos", F.unhex(F.sha2(ascii_lower(F.col("_line")), 256)).alias("_hash"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Bitmaps of the lines that go: _id, _th (hash of the text), _bucket, _n, _bits (bit i of byte i/8: line goes).

    Trailing zero bytes are cut off; documents that lose nothing have no row. A document of over 32,768 lines has
    a row for each bucket of that many lines.
    """
    spark = docs.sparkSession
    rows = docs.count()
    fraction = sample_fraction(spark, rows)
    picked = docs if fraction >= 1 else docs.sample(fraction, seed=11)
    heavy = heavy_keys(_occurrences(picked, id_col, text_col, min_chars).select("_hash"), "_hash", rows * fraction)
    dealt, salt = salted(_occurrences(docs, id_col, text_col, min_chars), "_hash", F.col("_id"), heavy)
    dealt = dealt.repartitionByRange("_hash", *salt)
    w = Window.partitionBy("_hash", *salt).orderBy(F.desc_nulls_last("_id"), "_th", "_pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("_id")).over(w)
    seen = dealt.withColumn("_new", F.when(before.isNull() | ~before["_id"].eqNullSafe(F.col("_id")), 1).otherwise(0))
    seen = seen.withColumns({"_docs": F.sum("_new").over(whole), "_first": F.first(F.struct("_id")).over(whole)["_id"]})
    if heavy is None:
        gone = seen.where((F.col("_docs") >= min_docs) & ~F.col("_id").eqNullSafe(F.col("_first")))
    else:
        hot = F.col("_salts") > 1
        seen = materialize(seen.where(hot | ((F.col("_docs") >= min_docs) & ~F.col("_id").eqNullSafe(F.col("_first")))).select("_id", "_th", "_pos", "_hash", "_salt", "_salts", "_docs", "_first"), "lines")
        heads = seen.where(hot).groupBy("_hash", "_salt").agg(F.max("_docs").alias("_docs"), F.max("_first").alias("_first"))
        merged = materialize(heads.groupBy("_hash").agg(F.sum("_docs").alias("_all_docs"), F.max("_first").alias("_all_first")), "heads")
        small = merged.count() <= 4 * partitions(spark)
        gone = seen.join(F.broadcast(merged) if small else merged, "_hash", "left")
        gone = gone.where(~hot | ((F.col("_all_docs") >= min_docs) & ~F.col("_id").eqNullSafe(F.col("_all_first"))))
    bit = F.col("_pos").cast("long") + 1
    at = gone.select("_id", "_th", F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_bit")).repartition("_id", "_th")
    return at.groupBy("_id", "_th", "_bucket").agg(
        F.countDistinct("_bit").alias("_n"), F.max("_bit").alias("_last"), F.bitmap_construct_agg("_bit").alias("_bits")
    ).select("_id", "_th", "_bucket", "_n", F.expr("substring(_bits, 1, cast(_last div 8 as int) + 1)").alias("_bits"))


def _bit(maps: Column, pos: Column) -> Column:
    """Whether line pos goes, by its bucket's bitmap."""
    bits = F.try_element_at(maps, (F.floor(pos / BUCKET) + 1).cast("int"))
    byte = F.conv(F.hex(F.substring(bits, (F.floor((pos % BUCKET) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (pos % 8).cast("int")), F.lit(0)) == 1


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row for each document: id_col, n_lines, n_dropped, drop_bitmap (map of bucket to bits, null: none), kept_text.

    Lines whose key (blanks stripped, A-Z lowered) has min_chars code points and is in min_docs documents go,
    except in the document with the largest identifier that holds it. Null text is one empty line. Rows with one
    identifier are one document when counting; a null identifier is a document of its own, smaller than any other.
    Rows that repeat identifier and text all come back, alike. An empty table gives an empty result.
    """
    maps = dropped_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("_id", "_th").agg(
        F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct(F.col("_bucket").cast("int"), "_bits"))).alias("_maps"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_did"), F.xxhash64(text).alias("_dth"), text.alias("_text"))
    both = base.join(maps, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dth") == F.col("_th")), "left")
    kept = F.filter(F.split("_text", "\n", -1), lambda _, i: ~_bit(F.col("_maps"), i))
    return both.select(
        F.col("_did").alias(id_col), F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"), F.col("_maps").alias("drop_bitmap"),
        F.when(F.col("_maps").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL AND k.doc_id <> g.last) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE g.key IS NULL OR k.doc_id = g.last), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY k.doc_id
"""
