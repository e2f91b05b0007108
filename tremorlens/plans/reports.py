"""Whole runs: a frozen design of experiments, and a descriptive report; each writes its tables and one summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import utm37, valid_coordinates
from ..functions.text import missing_word
from ..operators import design, explore, profile, proximity
from ..operators.groups import materialize
from ..operators.harmonize import assert_records
from ..operators.reconcile import domain_drift
from ..sources.sinks import markdown_table, plain, report_json, write_csv, write_parquet

RECORD = design.Columns("record_id", "domain", "leakage_group", "event_id", "latitude", "longitude", "damage_native", "damage_ordinal_native")


@dataclass(frozen=True)
class Experiment:
    """Folds over the domains of one dataset; groups come from nearby records of `near` datasets or, without these, are the domains."""

    name: str
    dataset: str
    domain: str
    domains: tuple[str, ...]
    readiness: str = "ready"
    validation: dict[str, str] = field(default_factory=dict)
    coordinates_required: bool = False
    spatial: bool = False
    conflicts: bool = False
    grouped_by_place: bool = False
    uncertainty: tuple[str, ...] = ()


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A report in any store that Spark writes, as one part."""
    df.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def make_design(datasets: dict[str, DataFrame], experiments: list[Experiment], out: str, near: tuple[str, ...] = (), external: str | None = None, radius: float = 100.0, buffer: float = 1000.0, contract: dict | None = None) -> dict:
    """Partitions of every experiment under `out`, the groups of nearby records, the reserved external set, and the summary, which is returned too.

    Every dataset must keep the record contract, and a dataset's domains must be those that its experiment declares.
    Cities of a spatial dataset must lie at least `buffer` metres apart. The external dataset is never evaluated.
    Nothing is fitted.
    """
    for df in datasets.values():
        assert_records(df, **(contract or {}))
    summary: dict = {"model_fitting_performed": False, "experiments": {}}
    groups = None
    close = [datasets[d].select("dataset_id", "record_id", "latitude", "longitude") for d in near if d in datasets]
    if close:
        every = close[0]
        for df in close[1:]:
            every = every.unionByName(df)
        sites = proximity.proximity_groups(every, "record_id", "latitude", "longitude", radius)
        groups = materialize(every.select("dataset_id", "record_id").join(sites, "record_id").withColumnRenamed("site", "leakage_group"))
        write_parquet(groups, f"{out}/engineering_groups")
    for e in experiments:
        if e.dataset not in datasets:
            continue
        df = datasets[e.dataset]
        drift = domain_drift(df, e.domain, list(e.domains)).limit(10).collect()
        if drift:
            raise ValueError(f"domains of {e.dataset} changed: {sorted((r.value, r.side) for r in drift)}")
        if e.spatial:
            east, north = utm37(F.col("latitude"), F.col("longitude"))
            ok = valid_coordinates(F.col("latitude"), F.col("longitude"))
            gaps = materialize(proximity.box_gaps(df.where(ok).select(e.domain, east.alias("x"), north.alias("y")), e.domain, "x", "y"))
            proximity.assert_gaps(gaps, buffer)
            summary.setdefault("city_separation_lower_bound_metres", {}).update({f"{r['first']}/{r['second']}": r["gap"] for r in gaps.collect()})
        rows = df.withColumn("domain", F.col(e.domain))
        if e.grouped_by_place and groups is not None:
            rows = rows.join(groups.select("record_id", "leakage_group"), "record_id", "left")
        else:
            rows = rows.withColumn("leakage_group", F.col(e.domain))
        folds = design.cyclic_folds(list(e.domains), e.validation)
        spread = F.concat_ws(":", *[F.col(c) for c in e.uncertainty]) if e.uncertainty else None
        prepared = materialize(design.prepare(rows, RECORD, folds, e.coordinates_required, e.spatial, e.conflicts, spread))
        write_parquet(design.parts_of(prepared, folds), f"{out}/{e.name}", by=["fold"])
        design.assert_disjoint(df.sparkSession.read.parquet(f"{out}/{e.name}"))
        counts = materialize(design.counts_of(prepared, folds))
        sums, classes = design.fold_summary(counts).collect(), design.fold_classes(counts).collect()
        found = []
        for f in folds:
            own = {r.partition: {"records": r.records, "groups": r.groups, "evaluation_weight_sum": r.weight, "native_class_counts": {}} for r in sums if r.fold == f.name}
            for r in classes:
                if r.fold == f.name and r.item in own:
                    own[r.item]["native_class_counts"][r.key] = r.records
            found.append({
                "test_domain": f.test, "validation_domain": f.validation, "training_domains": [d for d in e.domains if d not in (f.test, f.validation)], **own,
                "exclusions": {r.key: r.records for r in classes if r.fold == f.name and r.item == "exclusions"}, "empty_partition": any(r.empty for r in sums if r.fold == f.name),
                "small_validation_warning": any(r.small for r in sums if r.fold == f.name and r.partition == "validation"), "small_test_warning": any(r.small for r in sums if r.fold == f.name and r.partition == "test")})
        summary["experiments"][e.name] = {"readiness": e.readiness, "folds": found}
    if external in datasets:
        own, others = groups.where(F.col("dataset_id") == external), groups.where(F.col("dataset_id") != external)
        reserved = materialize(design.reserve_external(own, "record_id", "leakage_group", others, "leakage_group"))
        write_parquet(reserved, f"{out}/{external}_reserved")
        n, linked = reserved.agg(F.count(F.lit(1)), F.count_if("linked")).first()
        summary[f"{external}_reserved"] = {"records": n, "proximity_connected_to_survey": linked, "evaluation_enabled": False}
    any_df = next(iter(datasets.values()))
    write_text(any_df, f"{out}/summary.json", report_json(summary))
    return plain(summary)


def run_eda(df: DataFrame, out: str, intensities: tuple[str, ...] = ("PGA", "PGV", "SA_0p3", "SA_1p0"), grades: tuple[int, ...] = (0, 1, 2, 3, 4)) -> dict:
    """Tables behind the figures of a canonical survey table (CSV under `out`), a report, and the summary, which is returned too.

    The figures themselves are left to a plotting tool: every number they show is in a table here.
    """
    df = materialize(df)
    known = [c for c in df.columns if not c.startswith("raw__")]
    ok = valid_coordinates(F.col("latitude"), F.col("longitude"))
    tables = {
        "damage_rate_by_structure": explore.damage_rates(df, "structure_type", "damage_grade"), "damage_class_counts": explore.class_histogram(df, "damage_grade", list(grades)),
        "structure_type_counts": profile.value_counts(df, "structure_type"), "missingness": profile.missingness(df, known),
        "geographic_coverage": explore.geographic_coverage(df.withColumn("city", missing_word(F.col("city"))), "city", "latitude", "longitude", "damage_grade"), "shaking_accounting": explore.intensity_accounting(df, list(intensities)),
    }
    for c in intensities:
        tables[f"distribution_{c}"] = explore.histogram(df, c)
        tables[f"by_damage_{c}"] = explore.box_statistics(df.withColumn("damage_grade", F.coalesce(F.col("damage_grade").cast("string"), F.lit("NA"))), "damage_grade", c)
    tables = {name: materialize(t) for name, t in tables.items()}  # each has a row for a class, a city, a bin or a column
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}.csv")
    one = df.agg(
        F.count(F.lit(1)).alias("records"), F.count("damage_grade").alias("known_damage"), F.count("structure_type").alias("known_structure"), F.count_if(F.col("damage_grade").isNotNull() & F.col("structure_type").isNotNull()).alias("damage_and_structure"),
        F.count_if(ok).alias("valid_coordinate_records"), F.count_if(~ok).alias("excluded_coordinate_records"), F.count_distinct(F.when(ok, F.struct("latitude", "longitude"))).alias("unique_valid_coordinates")).first()
    accounting = {r.measure: {"used": r.used, "missing": r["missing"], "invalid": r.invalid, "min": r.least, "max": r.largest} for r in tables["shaking_accounting"].collect()}
    classes = {r["class"]: r.records for r in tables["damage_class_counts"].collect()}
    summary = one.asDict() | {"damage_class_counts": classes, "shaking_plot_accounting": accounting}
    write_text(df, f"{out}/summary.json", report_json(summary))
    report = [f"# Survey records\n\n{one.records} records at {one.unique_valid_coordinates} distinct valid coordinate pairs.\n"]
    report += [f"\n## {name}\n\n{markdown_table(tables[name])}" for name in ("damage_class_counts", "geographic_coverage", "damage_rate_by_structure")]
    write_text(df, f"{out}/report.md", "".join(report))
    return plain(summary)
