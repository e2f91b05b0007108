"""Leakage-safe partitions: held-out domains, quarantined groups, weights and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_cell, valid_coordinates
from .groups import attach, materialize

ROLES = ("train", "validation", "test", "excluded")


@dataclass(frozen=True)
class Columns:
    """Names of the columns that a design reads."""

    record: str
    domain: str
    group: str
    event: str
    lat: str
    lon: str
    label: str  # native label
    ordinal: str


@dataclass(frozen=True)
class Fold:
    name: str
    test: str
    validation: str

    def __post_init__(self):
        if self.test == self.validation:
            raise ValueError("test and validation domain are the same")


def cyclic_folds(domains: list[str], validation: dict[str, str] | None = None) -> list[Fold]:
    """Each domain is the test set once; the next one, or the one given for it, validates."""
    given = validation or {}
    return [Fold(f"fold_{d}", d, given.get(d, domains[(k + 1) % len(domains)])) for k, d in enumerate(domains)]


def eligibility(df: DataFrame, c: Columns, spatial: bool = False, conflicts: bool = False) -> DataFrame:
    """df with `reason`: why a row can't be used, or empty. Later checks win: a coordinate over a label when spatial,
    conflicting native labels at one coordinate (of any event; missing labels don't count) over both."""
    ok = valid_coordinates(F.col(c.lat), F.col(c.lon))
    if spatial:
        reason = F.when(~ok, "missing_or_invalid_coordinate").when(F.coalesce(F.col(c.label), F.lit("")) == "", "missing_native_label").otherwise("")
    else:
        reason = F.when(F.col(c.ordinal).isNull(), "missing_or_unmapped_native_damage").otherwise("")
    if not conflicts:
        return df.withColumn("reason", reason)
    placed = df.withColumns({"_la": F.when(ok, F.col(c.lat)), "_lo": F.when(ok, F.col(c.lon))})
    both = attach(placed, ["_la", "_lo"], {"_low": F.min(c.label), "_high": F.max(c.label)}, nulls=False)
    clash = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    return both.withColumn("reason", F.when(clash, "conflicting_labels_at_exact_coordinate").otherwise(reason)).drop("_la", "_lo", "_low", "_high")


def _crossing(f: Fold) -> Column:
    """Whether the group of a row (its `_domains`) has more than one role in a fold."""
    test, validation = (F.array_contains("_domains", d).cast("int") for d in (f.test, f.validation))
    return F.coalesce(test + validation + (F.size("_domains") > test + validation).cast("int") > 1, F.lit(False))


def prepare(df: DataFrame, c: Columns, folds: list[Fold], coordinate_required: bool = False, spatial: bool = False, conflicts: bool = True, uncertainty: str | Column | None = None) -> DataFrame:
    """A row for each record with what all folds need: _domain, leakage_group, reason, label, _cross (for each fold, whether its
    group has several roles) and `_kept`, the rows that each fold keeps at its place (null without a place). The records are read once and written slim."""
    ok, domain, group = valid_coordinates(F.col(c.lat), F.col(c.lon)), F.col(c.domain), F.col(c.group)
    name = F.lit(None).cast("string") if uncertainty is None else uncertainty if isinstance(uncertainty, Column) else F.col(uncertainty)
    # Domains that no fold tests or validates are alike: they train.
    named = sorted({d for f in folds for d in (f.test, f.validation)})
    base = eligibility(df, c, spatial)
    over = F.when(domain.isNull(), "missing_domain")
    if coordinate_required or spatial:
        over = F.coalesce(over, F.when(~ok, "missing_or_invalid_coordinate"))
    base = materialize(base.select(
        F.col(c.record).alias("record_id"), F.when(domain.isin(*named), domain).otherwise("").alias("_domain"), group.cast("string").alias("leakage_group"), F.col(c.label).alias("label"),
        F.col("reason").alias("_own"), over.alias("_over"),
        F.when(ok, F.coalesce(F.col(c.event).cast("string"), F.lit(""))).alias("_event"), F.when(ok, F.col(c.lat)).alias("_la"), F.when(ok, F.col(c.lon)).alias("_lo"),
        (grid_cell(F.col(c.lat), F.col(c.lon)) if spatial else F.coalesce(name, group.cast("string"))).alias("uncertainty_group")))
    both = attach(base, ["leakage_group"], {"_domains": F.collect_set("_domain")}, nulls=False)
    own = F.col("_own")
    if conflicts:
        both = attach(both, ["_la", "_lo"], {"_clash": F.min("label") != F.max("label")}, nulls=False, of=base)
        own = F.when(F.col("_clash"), "conflicting_labels_at_exact_coordinate").otherwise(own)
    # Whether the group crosses partitions, once for each fold: places and folds ask for it again and again.
    both = both.withColumns({"reason": F.coalesce("_over", own), "_cross": F.array(*[_crossing(f) for f in folds])}).drop("_own", "_over", "_clash", "_domains")
    both = materialize(both)
    kept = [F.count_if((F.col("reason") == "") & ~F.col("_cross")[k]) for k in range(len(folds))]
    return attach(both, ["_event", "_la", "_lo"], {"_kept": F.array(*kept)}, nulls=False)


def _in_folds(rows: DataFrame, folds: list[Fold], per_fold: list[Column]) -> DataFrame:
    """rows once for each fold: fold, partition, exclusion_reason, and value (its element of per_fold)."""
    d = F.col("_domain")
    each = F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("fold"), F.when(d == f.test, "test").when(d == f.validation, "validation").otherwise("train").alias("role"), F.col("_cross")[k].alias("crossing"), value.alias("value"))
        for k, (f, value) in enumerate(zip(folds, per_fold))]))
    out = rows.withColumn("_f", each)
    why = F.when(F.col("_f.crossing"), "group_crosses_domain_partition").otherwise(F.col("reason"))
    return out.withColumns({"fold": F.col("_f.fold"), "exclusion_reason": why, "partition": F.when(why != "", "excluded").otherwise(F.col("_f.role")), "value": F.col("_f.value")})


def _weight(excluded: Column, kept: Column) -> Column:
    """Weight of a row by the rows kept at its place (null without one)."""
    return F.when(excluded, F.lit(0.0)).when(kept.isNull(), F.lit(1.0)).otherwise(F.lit(1.0) / kept)


def parts_of(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """partition_folds of what prepare() gives."""
    out = _in_folds(prepared, folds, [F.col("_kept")[k] for k in range(len(folds))])
    weight = _weight(F.col("partition") == "excluded", F.col("value"))
    return out.select("fold", "record_id", "partition", "exclusion_reason", "leakage_group", weight.alias("evaluation_weight"), "uncertainty_group")


def partition_folds(df: DataFrame, c: Columns, folds: list[Fold], coordinate_required: bool = False, spatial: bool = False, conflicts: bool = True, uncertainty: str | Column | None = None) -> DataFrame:
    """All folds in one job: fold, record, partition, exclusion_reason, leakage_group, evaluation_weight, uncertainty_group.

    Precedence of reasons: a group that crosses partitions, a missing domain, a coordinate, then those of eligibility.
    Groups are compared before exclusions, over all rows; every row of a crossing group is quarantined. A kept row
    weighs 1 / kept rows at its event and coordinates (alone if these are invalid), an excluded one 0.
    """
    # Rows are multiplied by folds only at the end: which roles a group has, and how many rows a place keeps, are
    # found for all folds at once.
    return parts_of(prepare(df, c, folds, coordinate_required, spatial, conflicts, uncertainty), folds)


def counts_of(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """fold_counts of what prepare() gives."""
    place = [F.col("_kept")[k] for k in range(len(folds))]
    sums = prepared.groupBy("_domain", "leakage_group", "reason", "label").agg(
        F.any_value("_cross").alias("_cross"), F.count(F.lit(1)).alias("records"),
        *[F.sum(F.when(p.isNull(), 1.0).when(p > 0, F.lit(1.0) / p).otherwise(0.0)).alias(f"_w{k}") for k, p in enumerate(place)])
    out = _in_folds(sums, folds, [F.col(f"_w{k}") for k in range(len(folds))])
    weight = F.when(F.col("partition") == "excluded", F.lit(0.0)).otherwise(F.col("value"))
    return out.select("fold", "partition", "exclusion_reason", "leakage_group", "label", "records", weight.alias("weight"))


def fold_counts(df: DataFrame, c: Columns, folds: list[Fold], coordinate_required: bool = False, spatial: bool = False, conflicts: bool = True) -> DataFrame:
    """fold, partition, exclusion_reason, leakage_group, label, records, weight: partition_folds, counted.

    Records are counted by group, label and reason before they are multiplied by folds.
    """
    return counts_of(prepare(df, c, folds, coordinate_required, spatial, conflicts), folds)


def fold_summary(counts: DataFrame, small: int = 30) -> DataFrame:
    """Per fold and role (roles without rows too): records, groups, weight, warnings for empty and small partitions."""
    sums = counts.groupBy("fold", "partition").agg(F.sum("records").alias("records"), F.count_distinct("leakage_group").alias("groups"), F.round(F.sum("weight"), 6).alias("weight"))
    wide = sums.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("partition", F.struct("records", "groups", "weight")))).alias("m"))
    each = wide.select("fold", F.explode(F.array(*map(F.lit, ROLES))).alias("partition"), "m")
    got = F.col("m")[F.col("partition")]
    records = F.coalesce(got["records"], F.lit(0))
    return each.select("fold", "partition", records.alias("records"), F.coalesce(got["groups"], F.lit(0)).alias("groups"), F.coalesce(got["weight"], F.lit(0.0)).alias("weight"),
                       (F.col("partition").isin("train", "validation", "test") & (records == 0)).alias("empty"), (F.col("partition").isin("validation", "test") & (records < small)).alias("small"))


def fold_classes(counts: DataFrame) -> DataFrame:
    """fold, item (a role, or exclusions), key, records: native labels of each role (missing as <missing>) and reasons of exclusions."""
    labels = counts.select("fold", F.col("partition").alias("item"), F.coalesce("label", F.lit("<missing>")).alias("key"), "records")
    reasons = counts.where("partition = 'excluded'").select("fold", F.lit("exclusions").alias("item"), F.col("exclusion_reason").alias("key"), "records")
    return labels.unionByName(reasons).groupBy("fold", "item", "key").agg(F.sum("records").alias("records"))


def disjoint_violations(parts: DataFrame) -> DataFrame:
    """Per fold: repeated records, groups in more than one kept partition, excluded rows that weigh something.

    The folds' rows are written slim and read twice, by record and by group.
    """
    kept = F.when(F.col("partition") != "excluded", F.col("partition"))
    weighed = (F.col("partition") == "excluded") & (F.col("evaluation_weight") != 0)
    slim = materialize(parts.select("fold", "record_id", "leakage_group", kept.alias("kept"), weighed.alias("weighed")))
    records = slim.groupBy("fold", "record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("weighed").alias("w"))
    records = records.groupBy("fold").agg(F.sum("w").alias("weighed_exclusions"), F.count_if(F.col("n") > 1).alias("repeated_records"))
    groups = slim.where("leakage_group is not null").groupBy("fold", "leakage_group").agg((F.min("kept") != F.max("kept")).alias("split")).groupBy("fold").agg(F.count_if("split").alias("split_groups"))
    return records.join(groups, "fold", "left").na.fill(0)


def violations_of(prepared: DataFrame, folds: list[Fold]) -> DataFrame:
    """disjoint_violations of the partitions that prepare() leads to.

    Records and groups are aggregated with a count and a least and largest partition for each fold, and multiplied by
    folds only when there is one row left for all.
    """
    d, n = F.col("_domain"), range(len(folds))
    out = [(F.col("reason") != "") | F.col("_cross")[k] for k in n]
    role = [F.when(d == f.test, 2).when(d == f.validation, 1).otherwise(0) for f in folds]
    kept = [F.when(~out[k], role[k]).cast("byte") for k in n]
    weighs = [(out[k] & (_weight(out[k], F.col("_kept")[k]) != 0)).cast("int") for k in n]
    slim = materialize(prepared.select("record_id", "leakage_group", *[kept[k].alias(f"_k{k}") for k in n], *[weighs[k].alias(f"_w{k}") for k in n]))
    # A record is in every fold once for each of its rows.
    records = slim.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_w{k}").alias(f"_w{k}") for k in n])
    records = records.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count(F.lit(1)).alias("records"), *[F.sum(f"_w{k}").alias(f"_w{k}") for k in n])
    split = slim.where("leakage_group is not null").groupBy("leakage_group").agg(*[(F.min(f"_k{k}") != F.max(f"_k{k}")).alias(f"_s{k}") for k in n])
    split = split.agg(*[F.count_if(f"_s{k}").alias(f"_s{k}") for k in n])
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("fold"), F.col(f"_w{k}").alias("weighed_exclusions"), F.col("repeated").alias("repeated_records"), F.col(f"_s{k}").alias("split_groups")) for k, f in enumerate(folds)]))
    return records.crossJoin(F.broadcast(split)).where("records > 0").select(each.alias("_f")).select("_f.*")


def assert_disjoint(parts: DataFrame) -> None:
    bad = disjoint_violations(parts).where("repeated_records + split_groups + weighed_exclusions > 0").count()
    if bad:
        raise ValueError(f"{bad} folds are not disjoint")


def reserve_external(df: DataFrame, record: str, group: str, survey: DataFrame, survey_group: str) -> DataFrame:
    """External rows are never evaluated; `linked` tells those whose group the survey has too."""
    known = survey.select(F.col(survey_group).cast("string").alias("_g")).where("_g is not null").distinct().withColumn("linked", F.lit(True))
    return df.join(known, F.col(group).cast("string") == F.col("_g"), "left").select(
        F.col(record).alias("record_id"), F.lit("reserved_external").alias("partition"), F.lit(False).alias("evaluation_enabled"), F.coalesce("linked", F.lit(False)).alias("linked"))


def domain_complement(df: DataFrame, domain: str, folds: list[Fold]) -> DataFrame:
    """fold, domain: the domains of a table that a fold neither tests nor validates."""
    domains = df.where(F.col(domain).isNotNull()).select(F.col(domain).alias("domain")).distinct()
    each = domains.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("fold"), F.lit(f.test).alias("test"), F.lit(f.validation).alias("validation")) for f in folds])).alias("f"), "domain")
    return each.where((F.col("domain") != F.col("f.test")) & (F.col("domain") != F.col("f.validation"))).select("f.fold", "domain")
