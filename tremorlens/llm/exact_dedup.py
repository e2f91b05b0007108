"""Operator 1: exact dedup by content sort.

Sampled splitters range-partition the texts by (prefix of the bytes, hash), an external sort places equal texts
next to each other, and Spark's window operator compares each whole normalised text with its predecessor to find
where a run of equal texts ends. Texts that fill half a partition are salted by identifier, sorted like the rest,
and only the heads of their sub-runs are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, heavy_keys, materialize, partitions, salted, sample_fraction

#: Code points of a text that lead its range key; a hash of the whole text follows, so shared openings spread.
PREFIX = 48


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False) -> DataFrame:
    """One row for each input row: which row of its group of equal texts stays.

    Returns id_col, keep_id, group_size, kept, text_sha256 and, with carry, the whole input row as struct `row`.
    keep: "smallest" or "largest" identifier. Null text counts as empty (so does ""), equal to each other. A null
    identifier loses against any other; rows that repeat identifier and text count in group_size and one of them
    stays. An empty table gives an empty result. Other columns are ignored (or carried), whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The routing key uses full lower-casing: coarser than A-Z lower-casing, so equal texts share it, and cheap.
    coarse = F.lower(text)
    key = F.xxhash64(coarse)
    rows = docs.count()
    fraction = sample_fraction(spark, rows)
    picked = docs if fraction >= 1 else docs.sample(fraction, seed=7)
    heavy = heavy_keys(picked.select(key.alias("_h")), "_h", rows * fraction)
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.substring(coarse, 1, PREFIX).alias("_prefix"), key.alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    keyed, salt = salted(keyed, "_h", F.col("_id"), heavy)
    where = ["_prefix", "_h", *salt]
    found = _runs(keyed, where, keep)
    best = F.max if keep == "largest" else F.min
    if heavy is not None:
        heads = _runs(keyed.drop("_row").where(F.col("_salts") > 1), where, keep).where(F.col("_nth") == 1)
        merged = materialize(heads.groupBy("_sha").agg(best("_best").alias("_all_best"), F.sum("_size").alias("_all_size")), "dedup")
        # A few rows for each listed key; broadcast only if the count bears that out.
        small = merged.count() <= 64 * partitions(spark)
        found = found.join(F.broadcast(merged) if small else merged, "_sha", "left")
        hot = F.col("_salts") > 1
        found = found.withColumns({
            "_nth": F.when(hot & ~F.col("_best").eqNullSafe(F.col("_all_best")), F.lit(2)).otherwise(F.col("_nth")),
            "_size": F.when(hot, F.col("_all_size")).otherwise(F.col("_size")),
            "_best": F.when(hot, F.col("_all_best")).otherwise(F.col("_best")),
        })
    return found.select(
        F.col("_id").alias(id_col), F.col("_best").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
        (F.col("_nth") == 1).alias("kept"), F.col("_sha").alias("text_sha256"), *([F.col("_row").alias("row")] if carry else []),
    )


def _runs(keyed: DataFrame, where: list[str], keep: str) -> DataFrame:
    """Range-partition, sort, and number the rows of each run of equal normalised texts."""
    dealt = keyed.repartitionByRange(*where).withColumn("_norm", ascii_lower(F.col("_text"))).drop("_text")
    run = Window.partitionBy(*where, "_norm")
    first = F.desc_nulls_last("_id") if keep == "largest" else F.asc_nulls_last("_id")
    ordered = run.orderBy(first)
    to_here = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.withColumns({
        "_nth": F.row_number().over(ordered), "_best": F.first("_id").over(to_here), "_size": F.count(F.lit(1)).over(whole),
    }).withColumn("_sha", F.sha2("_norm", 256)).drop("_norm")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP1_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
