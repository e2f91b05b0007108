"""Scores of predictions over ordered classes, precision and recall, calibration, and bootstrap over clusters."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def _count_of(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("double")


def ordinal_scores(df: DataFrame, truth: str, chances: list[str], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, records, weight, and the scores of one prediction a row: chances has a column for each class, in order.

    ranked_probability (mean squared distance of the two cumulative distributions, by class gaps), brier, log_loss,
    and of the likeliest class (the lowest of equals): mae, accuracy, macro_f1 (over classes that occur on either side),
    weighted_kappa (squared weights; null where chance alone decides). Rows without truth or with a null chance are left
    out. One aggregate with a sum for each pair of classes; nothing else is shuffled.
    """
    k, y, p = len(chances), F.col(truth), [F.col(c).cast("double") for c in chances]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(y.between(0, k - 1))
    for c in p:
        known = known.where(c.isNotNull())
    best = F.array_position(F.array(*p), F.greatest(*p)) - 1
    so_far = list(accumulate(p))
    rps = sum((F.pow(s - F.when(y <= j, 1.0).otherwise(0.0), 2) for j, s in enumerate(so_far[:-1])), F.lit(0.0)) / (k - 1)
    brier = sum((F.pow(c - F.when(y == j, 1.0).otherwise(0.0), 2) for j, c in enumerate(p)), F.lit(0.0))
    own = F.element_at(F.array(*p), (y + 1).cast("int"))
    row = known.select(*by, y.cast("int").alias("_y"), best.cast("int").alias("_c"), w.alias("_w"), rps.alias("_r"), brier.alias("_b"), (-F.log(F.greatest(own, F.lit(1e-15)))).alias("_l"))
    cell = [[F.sum(F.when((F.col("_y") == i) & (F.col("_c") == j), F.col("_w")).otherwise(0.0)).alias(f"_{i}_{j}") for j in range(k)] for i in range(k)]
    mean = lambda c, n: (F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(n)
    sums = row.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.sum("_w").alias("weight"), mean("_r", "ranked_probability"), mean("_b", "brier"), mean("_l", "log_loss"), *[c for r in cell for c in r])
    n = [[F.col(f"_{i}_{j}") for j in range(k)] for i in range(k)]
    total = F.col("weight")
    rows, columns = [sum(r, F.lit(0.0)) for r in n], [sum((n[i][j] for i in range(k)), F.lit(0.0)) for j in range(k)]
    f1 = [F.when(rows[i] + columns[i] > 0, 2 * n[i][i] / (rows[i] + columns[i])) for i in range(k)]
    seen = sum((F.when(rows[i] + columns[i] > 0, 1.0).otherwise(0.0) for i in range(k)), F.lit(0.0))
    far = [[float((i - j) ** 2) for j in range(k)] for i in range(k)]
    found = sum((far[i][j] * n[i][j] for i in range(k) for j in range(k)), F.lit(0.0))
    by_chance = sum((far[i][j] * rows[i] * columns[j] for i in range(k) for j in range(k)), F.lit(0.0)) / total
    return sums.select(
        *by, "records", "weight", "ranked_probability", "brier", "log_loss",
        (sum((abs(i - j) * n[i][j] for i in range(k) for j in range(k)), F.lit(0.0)) / total).alias("mae"), (sum((n[i][i] for i in range(k)), F.lit(0.0)) / total).alias("accuracy"),
        (sum((F.coalesce(c, F.lit(0.0)) for c in f1), F.lit(0.0)) / F.nullif(seen, F.lit(0.0))).alias("macro_f1"), (1 - found / F.nullif(by_chance, F.lit(0.0))).alias("weighted_kappa"))


def precision_recall(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, positives, negatives at it, true_positives and false_positives from it on, precision, recall: a row for each score.

    Rows that tie are one row; what lies above is added up over ranges of scores, so no task sees them all. Rows without
    label or score are left out.
    """
    ties = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives"))
    sums = running_sums(ties, [F.desc("threshold")], {"true_positives": "positives", "false_positives": "negatives"})
    every = F.broadcast(sums.agg(F.sum("positives").alias("_all")))  # one row
    return sums.crossJoin(every).select("threshold", "positives", "negatives", "true_positives", "false_positives", (F.col("true_positives") / (F.col("true_positives") + F.col("false_positives"))).alias("precision"), (F.col("true_positives") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """records, positives, average_precision: the area under steps of precision over recall (null without positives)."""
    curve = precision_recall(df, label, score)
    sums = curve.agg(F.sum(F.col("positives") + F.col("negatives")).alias("records"), F.sum("positives").alias("positives"), F.sum(F.col("precision") * F.col("positives")).alias("_area"))
    return sums.select(F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("positives", F.lit(0)).alias("positives"), (F.col("_area") / F.nullif(F.col("positives"), F.lit(0))).alias("average_precision"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, equal_counts: bool = True) -> DataFrame:
    """bin (from 0), records, score_mean, positive_rate, and gap (their absolute difference) of rows in bins of score.

    equal_counts: bins of alike numbers of rows, ties together in the bin where the middle of their places lies; these
    places come from running sums over ranges of scores. If not, bins of alike width between 0 and 1.
    """
    ties = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("k"))
    if equal_counts:
        placed = running_sums(ties, [F.col("s")], {"upto": "n"})
        every = F.broadcast(ties.agg(F.sum("n").alias("_all")))  # one row
        placed = placed.crossJoin(every)
        # Twice the middle place, so that it is a whole number.
        bin_ = F.least(F.floor((2 * F.col("upto") - F.col("n")) * bins / (2 * F.col("_all"))), F.lit(bins - 1))
    else:
        placed, bin_ = ties, F.least(F.greatest(F.floor(F.col("s") * bins), F.lit(0)), F.lit(bins - 1))
    sums = placed.groupBy(bin_.cast("int").alias("bin")).agg(F.sum("n").alias("records"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("score_mean"), (F.sum("k") / F.sum("n")).alias("positive_rate"))
    return sums.withColumn("gap", F.abs(F.col("score_mean") - F.col("positive_rate")))


# Odd multipliers of a hash of 32 bits that other engines can repeat.
MIX = (0x45D9F3B, 0x119DE1F3)
LOW = 0xFFFFFFFF
#: Of 2 ** 32 hashes, how many lie below the chance of at most 0, 1, 2 ... of a Poisson variable of mean 1.
CHANCES = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def with_times_drawn(df: DataFrame, key: str, draw: str, seed: int, name: str) -> DataFrame:
    """df with how often a cluster (a whole number) is in a draw: Poisson of mean 1, as for draws with replacement from many
    clusters. The hash of cluster, draw and seed is made step by step, each a column, so that none is written out twice."""
    low, h = F.lit(LOW), F.col("_h")
    out = df.withColumn("_h", F.col(key).cast("long").bitwiseAND(low).bitwiseXOR((F.col(draw).cast("long") * 0x9E3779B1 + seed).bitwiseAND(low)))
    for m in (*MIX, MIX[0]):
        out = out.withColumn("_h", (h.bitwiseXOR(F.shiftright(h, 16)) * m).bitwiseAND(low))
    out = out.withColumn("_h", h.bitwiseXOR(F.shiftright(h, 15)))
    times = sum((F.when(h >= c, 1).otherwise(0) for c in CHANCES[1:]), F.when(h >= CHANCES[0], 1).otherwise(0))
    return out.withColumn(name, times).drop("_h")


def cluster_bootstrap(df: DataFrame, cluster: str, part: str, whole: str, by: list[str] = (), draws: int = 2000, seed: int = 20231005, level: float = 0.95) -> DataFrame:
    """by, clusters, estimate (sum of part / sum of whole), low, high: percentiles of the estimate over draws of whole clusters.

    cluster: a whole number. Rows are summed to clusters first; draws multiply clusters, never rows, and are summed
    within a task before they are shuffled. A draw in which the whole is 0 doesn't count.
    """
    sums = df.where(F.col(cluster).isNotNull()).groupBy(*by, F.col(cluster).cast("long").alias("_g")).agg(F.sum(part).alias("_p"), F.sum(whole).alias("_w"))
    each = sums.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # Not filtered to those drawn: the filter would be pushed through the steps of the hash, and written out many times.
    each = with_times_drawn(each, "_g", "_d", seed, "_n")
    drawn = each.groupBy(*by, "_d").agg(F.sum(F.col("_p") * F.col("_n")).alias("_p"), F.sum(F.col("_w") * F.col("_n")).alias("_w"))
    tail = (1 - level) / 2
    ends = drawn.groupBy(*by).agg(F.percentile(F.col("_p") / F.nullif(F.col("_w"), F.lit(0)), F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    found = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), (F.sum("_p") / F.nullif(F.sum("_w"), F.lit(0))).alias("estimate"))
    both = found.join(ends, list(by), "left") if by else found.crossJoin(F.broadcast(ends))
    return both.select(*by, "clusters", "estimate", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))
