"""Small helpers that several corpus operators share."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findable(spark: SparkSession) -> None:
    """Put this library on the path of the Python workers, as it is on the driver's (elsewhere: --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (root, known.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A local one is made only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df in the shared folder and read it back: cuts the lineage and survives lost executors. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more: all that was made of it is written itself."""
    if files := df.inputFiles():
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished work when the driver collects garbage; this asks it to, between large steps."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII texts take the fast built-in; the others are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_fraction(spark: SparkSession, rows: int) -> float:
    """Fraction that gives about 400 rows for each shuffle partition: enough to see a key that would unbalance one."""
    return min(1.0, max(20_000, 400 * partitions(spark)) / max(rows, 1))


def heavy_keys(keys: DataFrame, key: str, expected: float) -> DataFrame | None:
    """Keys of a row sample that fill half a shuffle partition or more, with the number of salts for each.

    keys: sampled rows with column `key`; expected: sampled rows (or documents) in all. At most four keys a
    shuffle partition are returned, so the list (never the rows) is small enough to broadcast. It steers load
    balance only: results are the same whichever keys are listed.
    """
    spark = keys.sparkSession
    most = 4 * partitions(spark)
    share = max(expected / most, 1e-9)
    found = (
        keys.groupBy(key).count().where(F.col("count") >= max(16, math.ceil(2 * share)))
        .orderBy(F.desc("count")).limit(most)
        .select(key, F.ceil(F.col("count") / F.lit(share)).cast("int").alias("_salts"))
    )
    rows = found.collect()
    return spark.createDataFrame(rows, found.schema) if rows else None


def salted(df: DataFrame, key: str, by: Column, heavy: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """df with _salts (1 for ordinary keys) and _salt (rows of a heavy key are dealt by `by` over its salts).

    Also the names of the columns to partition by after the key: none without heavy keys, as a literal _salt is
    folded out of a range partitioning but not out of the window above it, which would then shuffle again.
    """
    if heavy is None:
        return df.withColumns({"_salts": F.lit(1), "_salt": F.lit(0)}), []
    out = df.join(F.broadcast(heavy), key, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    return out.withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(by), F.col("_salts"))).otherwise(0).cast("int")), ["_salt"]
