"""Row numbers and running sums over a whole table, without a window that has all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import materialize

#: monotonically_increasing_id() counts the rows of a partition in its lower bits.
ROW_BITS = 33


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df lacks."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
    return out


def in_ranges(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """df by ranges of `order`, sorted and written; `place` has the partition in its upper bits and the row in its lower ones.

    Written once, so every later read finds the rows at the same places, whichever executor is lost. Rows that `order`
    doesn't tell apart stay in one range: it should end with a key.
    """
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))


def _starts(rows: DataFrame, place: str, part: str, sums: dict[str, Column]) -> DataFrame:
    """Totals of all partitions before each one: a row for each partition, so small that the driver adds them up."""
    spark = rows.sparkSession
    each = rows.groupBy(F.shiftright(place, ROW_BITS).alias(part)).agg(*[v.alias(n) for n, v in sums.items()])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema.fields)
    before, out = [0] * len(sums), []
    for r in sorted(each.collect(), key=lambda r: r[0]):
        out.append((r[0], *before))
        before = [b + (v or 0) for b, v in zip(before, r[1:])]
    return spark.createDataFrame(out, fields)


def numbered_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`: 1, 2, 3 and so on in this order.

    One shuffle by ranges; the number is the place in the range and the sizes of those before. Rows alike in `order`
    get neighbouring numbers, in no set order. An empty table stays empty.
    """
    place, part, start = _free(df, "_place", "_part", "_start")
    rows = in_ranges(df, order, place)
    starts = F.broadcast(_starts(rows, place, part, {start: F.count(F.lit(1))}))  # a row for each partition
    number = F.col(start) + F.col(place).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return rows.join(starts, F.shiftright(place, ROW_BITS) == F.col(part)).select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running totals: sums maps a new column to the one that it adds up, in this order, the row itself included.

    Rows that tie should be summed to one before. Range partitions are summed on their own and shifted by the totals
    of those before; the largest task has one range. Nulls add nothing. Whole numbers and decimals are added exactly.
    """
    from pyspark.sql import Window

    place, part = _free(df, "_place", "_part")
    starts = _free(df, *[f"_before_{k}" for k in range(len(sums))])
    rows = in_ranges(df, order, place).withColumn(part, F.shiftright(place, ROW_BITS))
    before = F.broadcast(_starts(rows, place, part, {s: F.sum(F.col(f"`{c}`")) for s, c in zip(starts, sums.values())}).withColumnRenamed(part, f"{part}_of"))
    w = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({n: F.coalesce(F.sum(F.col(f"`{c}`")).over(w), F.lit(0)) for n, c in sums.items()})
    both = own.join(before, F.col(part) == F.col(f"{part}_of"))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(n) + F.col(s)).alias(n) for n, s in zip(sums, starts)])
