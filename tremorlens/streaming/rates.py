"""Extension: damage rates over a stream of records, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(records: DataFrame, time: str, structure: str, grade: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per window and structure: records, known, damaged, rate. Works on a batch and on a stream with a watermark."""
    g = F.col(grade)
    out = records.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.coalesce(F.col(structure), F.lit("<missing>")).alias("structure")).agg(
        F.count(F.lit(1)).alias("records"), F.count(g).alias("known"), F.count_if(g >= 1).alias("damaged"))
    return out.select(F.col("w.start").alias("start"), "structure", "records", "known", "damaged", F.round(F.try_divide(F.col("damaged").cast("double"), F.col("known")), 9).alias("damage_rate"))
