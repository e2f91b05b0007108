"""Rules that report, and never repair, values out of their domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fractional


@dataclass(frozen=True)
class Rule:
    """A violation: field, name of the rule, and when it is broken."""

    field: str
    name: str
    broken: Column


def _infinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def coordinate_rules(lat: str, lon: str) -> list[Rule]:
    """Range of each coordinate; the (0, 0) pair counts against the latitude."""
    la, lo = F.col(lat), F.col(lon)
    return [
        Rule(lat, "latitude_range", la.isNotNull() & ~la.between(-90, 90)), Rule(lon, "longitude_range", lo.isNotNull() & ~lo.between(-180, 180)),
        Rule(lat, "zero_pair", (la == 0) & (lo == 0)),
    ]


def whole_number(field: str, least: int) -> Rule:
    c = F.col(field)
    return Rule(field, f"whole_number_from_{least}", c.isNotNull() & (_infinite(c) | fractional(c) | (c < least)))


def number_range(field: str, least: float, most: float) -> Rule:
    c = F.col(field)
    return Rule(field, f"between_{least:g}_and_{most:g}", c.isNotNull() & (_infinite(c) | ~c.between(least, most)))


def positive(field: str) -> Rule:
    c = F.col(field)
    return Rule(field, "positive", c.isNotNull() & (_infinite(c) | (c <= 0)))


def not_negative(field: str) -> Rule:
    c = F.col(field)
    return Rule(field, "not_negative", c.isNotNull() & (_infinite(c) | (c < 0)))


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, field, rule, value (as text) of every broken rule, in one pass."""
    rows = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"), F.round(F.col(r.field), 6).cast("double").alias("value"))) for r in rules]
    return df.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("v")).select(key, "v.*")


def quality_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("records"))


def fail_on_errors(found: DataFrame) -> None:
    """Raise after everything is written, if any violation was found."""
    n = found.count()
    if n:
        raise ValueError(f"{n} violations")
