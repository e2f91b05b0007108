"""Canonical tables: every row and raw cell is kept, values are typed by a column dictionary, anomalies become rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import at_least, iso_timestamp, lookup, normalize, numbered, safe_double


@dataclass(frozen=True)
class Field:
    """One entry of a column dictionary. kind: text, number, log (natural logarithm of the value) or date."""

    source: str
    canonical: str
    kind: str = "text"
    units: str = ""
    description: str = ""

    @property
    def type(self) -> T.DataType:
        return {"text": T.StringType(), "date": T.TimestampNTZType()}.get(self.kind, T.DoubleType())


def dictionary(spark, fields: list[Field]) -> DataFrame:
    """The column dictionary as a table."""
    return spark.createDataFrame([(f.source, f.canonical, f.kind, f.units, f.description) for f in fields], "source string, canonical string, kind string, units string, description string")


def raw_columns(df: DataFrame, prefix: str = "raw__") -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(prefix + c) for c in df.columns])


def _typed(f: Field) -> Column:
    c = F.col(f"`{f.source}`").cast("string")
    if f.kind == "date":
        return iso_timestamp(c)
    if f.kind == "text":
        return normalize(c)
    return F.exp(safe_double(c)) if f.kind == "log" else safe_double(c)


def canonicalize(df: DataFrame, fields: list[Field], key: str, label: str | None = None, labels: dict[str, int] | None = None) -> DataFrame:
    """key, the canonical columns, the raw cells as raw__ text, the mapped grade, and `issues` (array of field, kind, raw_value).

    A header that differs from the dictionary is an error. A cell that holds text but doesn't parse is null and an
    issue; so is a label that isn't in the vocabulary.
    """
    wanted, found = {f.source for f in fields} | {key}, set(df.columns)
    if wanted != found:
        raise ValueError(f"columns differ from the dictionary: missing {sorted(wanted - found)}, unknown {sorted(found - wanted)}")
    kinds = {"date": "date_parse_error", "number": "numeric_parse_error", "log": "numeric_parse_error"}
    checks = [(f.canonical, f.source, kinds[f.kind], normalize(F.col(f"`{f.source}`").cast("string")).isNotNull() & _typed(f).isNull()) for f in fields if f.kind in kinds]
    extra = []
    if label:
        source = next(f.source for f in fields if f.canonical == label)
        word = normalize(F.col(f"`{source}`").cast("string"))
        extra = [lookup(word, labels).cast("int").alias("damage_grade")]
        checks.append((label, source, "unmapped_damage_label", word.isNotNull() & lookup(word, labels).isNull()))
    rows = [F.when(bad, F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.col(f"`{s}`").cast("string").alias("raw_value"))) for n, s, k, bad in checks]
    issues = F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast("array<struct<field:string,kind:string,raw_value:string>>")
    return df.select(F.col(key), *[_typed(f).alias(f.canonical, metadata={"units": f.units, "description": f.description, "source": f.source}) for f in fields], *extra,
                     *[F.col(f"`{f.source}`").cast("string").alias("raw__" + f.source) for f in fields], issues.alias("issues"))


def issue_rows(canonical: DataFrame, key: str) -> DataFrame:
    return canonical.select(key, F.explode("issues").alias("i")).select(key, "i.*")


def native_damage(df: DataFrame, label: str, labels: dict[str, int], candidate_from: int | None = None) -> DataFrame:
    """Native label (empty is null), its ordinal or null, and with a threshold the candidate flag of ordinals from there on.

    The mapping status tells what the whole source allows: a candidate flag is provisional, without one labels are native only.
    """
    native = F.nullif(F.col(label), F.lit(""))
    ordinal = lookup(native, labels).cast("int")
    status = F.lit("native_only" if candidate_from is None else "provisional_not_for_pooling")
    flag = at_least(ordinal, candidate_from) if candidate_from is not None else F.lit(None).cast("int")
    return df.withColumns({"damage_native": native, "damage_ordinal_native": ordinal, "damage_mapping_status": status, "high_damage_candidate": flag})


def schema_violations(df: DataFrame, expected: T.StructType) -> list[str]:
    """Columns that are missing, unknown, out of order or of another type."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in expected}
    out = [f"missing {c}" for c in want if c not in have] + [f"unknown {c}" for c in have if c not in want]
    out += [f"type of {c}: {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    return out or ([] if list(have) == list(want) else ["order of columns"])


def table_violations(df: DataFrame, record: str, row: str, form: str, label: str, grade: str, labels: dict[str, int], structure: str, flag: str, first: int = 2) -> DataFrame:
    """rule, records: breaches of what a canonical table promises beside its columns and types, rules without any included.

    Records have an identifier of the given form made of their row, unique and not null; rows are unique and start at
    `first`; the grade is that of the label; the flag says whether grade and structure are both known.
    """
    r, n = F.col(record), F.col(row)
    each = {
        "null_record": r.isNull(), "null_row": n.isNull(), "row_before_first": n < first, "record_is_not_its_row": ~r.eqNullSafe(numbered(form, n.cast("long"))),
        "grade_is_not_its_label": ~F.col(grade).cast("int").eqNullSafe(lookup(F.col(label), labels).cast("int")),
        "flag_is_wrong": ~F.col(flag).eqNullSafe(F.col(grade).isNotNull() & F.col(structure).isNotNull()),
    }
    one = df.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(rule) for rule, broken in each.items()]).unpivot([], list(each), "rule", "records")
    for rule, column in (("repeated_record", r), ("repeated_row", n)):
        sizes = df.where(column.isNotNull()).groupBy(column.alias("k")).count()
        one = one.unionByName(sizes.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("records")).select(F.lit(rule).alias("rule"), "records"))
    return one


def assert_table(df: DataFrame, expected: T.StructType, sources: list[str], **names) -> None:
    """Raise unless df has the expected columns and types, every raw cell of its sources as text, and breaks no rule of table_violations."""
    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name)}" for f in expected if have.get(f.name) != f.dataType.simpleString()] + [f"raw__{c}: {have.get('raw__' + c)}" for c in sources if have.get("raw__" + c) != "string"]
    if wrong:
        raise ValueError(f"columns or types differ: {wrong}")
    if broken := table_violations(df, **names).where("records > 0").orderBy("rule").collect():
        raise ValueError("; ".join(f"{r.rule} in {r.records}" for r in broken))
