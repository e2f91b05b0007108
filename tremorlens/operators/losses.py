"""Losses of simulated years: exceedance curves of the largest event and of the sum of a year, and losses of return periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def yearly(events: DataFrame, year: str, loss: str, order: str | None = None) -> DataFrame:
    """year, most (of one event), total: a row for each year with losses; null losses are left out.

    order: key of the events by which a year's losses are added, so that a total of doubles (and which years tie) doesn't
    depend on how rows are split over tasks; a task then holds a year's keys and losses.
    """
    known = events.where(F.col(year).isNotNull() & F.col(loss).isNotNull())
    if order is None:
        return known.groupBy(F.col(year).alias("year")).agg(F.max(loss).alias("most"), F.sum(loss).alias("total"))
    in_order = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col(loss).alias("v"))))
    each = known.groupBy(F.col(year).alias("year")).agg(F.max(loss).alias("most"), in_order.alias("_all"))
    return each.select("year", "most", F.aggregate(F.slice("_all", 2, 1 << 30), F.col("_all")[0]["v"], lambda total, e: total + e["v"]).alias("total"))


def exceedance(years: DataFrame, count: int) -> DataFrame:
    """curve (OEP of the largest event of a year, AEP of its sum), loss, place (years with that loss or more), chance
    (of that in a year, of `count` simulated ones), return_period.

    Years that tie are one row. Places are running sums over ranges of losses, so any number of years will do.
    """
    curves = []
    for name, column in (("OEP", "most"), ("AEP", "total")):
        ties = years.groupBy(F.col(column).alias("loss")).agg(F.count(F.lit(1)).alias("times"))
        curves.append(running_sums(ties, [F.desc("loss")], {"place": "times"}).select(F.lit(name).alias("curve"), "loss", "place"))
    both = curves[0].unionByName(curves[1])
    return both.select("curve", "loss", "place", (F.col("place") / count).alias("chance"), (count / F.col("place")).alias("return_period"))


def probable(years: DataFrame, count: int, return_periods: list[float]) -> DataFrame:
    """curve, return_period, loss (the least that is reached or passed less often than once in that period; the largest
    where the period is longer than the simulation), average_annual_loss (of all simulated years).

    One pass over the curve with a minimum for each period.
    """
    curve = exceedance(years, count)
    # Of years that tie, the first places count too: what precedes a row ends where its ties begin.
    ties = [F.min(F.when(F.col("first") <= count / p, F.col("loss"))).alias(f"_{k}") for k, p in enumerate(return_periods)]
    before = years.groupBy(F.col("most").alias("loss")).count().withColumn("curve", F.lit("OEP")).unionByName(years.groupBy(F.col("total").alias("loss")).count().withColumn("curve", F.lit("AEP")))
    firsts = curve.join(before, ["curve", "loss"]).withColumn("first", F.col("place") - F.col("count") + 1)
    ends = firsts.groupBy("curve").agg(F.max("loss").alias("_top"), *ties)
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("return_period"), F.coalesce(F.col(f"_{k}"), F.col("_top")).alias("loss")) for k, p in enumerate(return_periods)]))
    mean = years.agg((F.sum("total") / count).alias("average_annual_loss"))
    return ends.select("curve", each.alias("e")).select("curve", "e.return_period", "e.loss").crossJoin(F.broadcast(mean))
