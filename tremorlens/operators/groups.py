"""Group values attached to rows, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, keys: list[str], values: dict[str, Column], nulls: bool = True, of: DataFrame | None = None) -> DataFrame:
    """df with aggregates of each row's group (in `of`, where that is another table with the keys, as what df was made from).

    Aggregated before the shuffle and joined back, so a group that holds much of the table is neither sorted nor
    buffered in one task; the join side may be split where keys are skewed. nulls: whether null keys are a group
    like any other; if not, their rows get nulls and take no part in the shuffle of groups.
    """
    rows = df if of is None else of
    rows = rows if nulls else rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    sums = rows.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *values)
    pairs = [(F.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)]
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if nulls else a == b for a, b in pairs])
    return df.join(sums, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def materialize(df: DataFrame) -> DataFrame:
    """Written under spark.checkpoint.dir and read back: lineage ends there. Only on one machine a folder is made where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/groups-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: smallest node of the component of every node that has an edge.

    Rounds of two steps: neighbours above a node are tied to the least one around it, then neighbours below it
    are. Both aggregate before the shuffle; the number of rounds grows with the logarithm of the longest chain.
    """
    x, y = F.col("x"), F.col("y")
    edges = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    before = None
    while True:
        around = edges.unionByName(edges.select(y.alias("x"), x.alias("y")))
        # Minima are written before they are joined, so that the rows of a centre of many links can be split.
        least = materialize(around.groupBy("x").agg(F.least(F.min("y"), x).alias("m")))
        up = materialize(around.where(y > x).join(least, "x").select(y.alias("x"), F.col("m").alias("y")).distinct())
        least = materialize(up.groupBy("x").agg(F.min("y").alias("m")))
        down = up.join(least, "x").select(F.explode(F.array(F.struct(y.alias("x"), F.col("m").alias("y")), F.struct(x, F.col("m").alias("y")))).alias("e")).select("e.*")
        edges = materialize(down.where(x != y).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(x.alias("node"), y.alias("root")).unionByName(edges.select(y.alias("node"), y.alias("root")).distinct())
        before = now
