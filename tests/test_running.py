"""Row numbers and running sums over ranges against plain loops."""

import random

from pyspark.sql import functions as F

from tremorlens.operators.running import numbered_rows, running_sums


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([1, 2, 2, 2, 5, None]), rng.randint(-3, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, v int, n int").repartition(7).withColumns({"_place": F.lit("clash"), "_part": F.lit("clash"), "_start": F.lit("clash")})
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    got = numbered_rows(df, [F.col("v"), F.desc("k")], "number").collect()
    assert {r.k: r.number for r in got} == {r[0]: i + 1 for i, r in enumerate(order)} and got[0]._place == "clash"
    total, want = 0, {}
    for k, _, n in order:
        want[k] = total = total + n
    assert {r.k: r.total for r in running_sums(df, [F.col("v"), F.desc("k")], {"total": "n"}).collect()} == want
    assert numbered_rows(df.limit(0), [F.col("v")], "number").collect() == []
