"""Parquet, CSV and JSON outputs."""

from __future__ import annotations

import json
import platform
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, single: bool = False, by: list[str] | None = None, codec: str = "zstd") -> None:
    """single: one file, for outputs known to be small; by: folders for each value of these columns."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite").option("compression", codec)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def finite(df: DataFrame) -> DataFrame:
    """df with null in place of numbers that aren't finite, so that its rows can be written as JSON."""
    real = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")) for c in real}) if real else df


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a row, null fields included."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _as_json(value):
    """What the encoder doesn't know: numbers and arrays of numpy by their values, sets as lists, missing values as null, the rest as text."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if isinstance(value, set | frozenset):
        return sorted(value, key=str)
    return None if pd.isna(value) is True else str(value)


def plain(value):
    """A driver's summary as JSON holds it: written and read once, with null for what isn't finite."""
    return json.loads(json.dumps(value, default=_as_json), parse_constant=lambda name: None)


def report_json(value) -> str:
    """Keys in order, no NaN, other scripts as they are, with a last newline."""
    return json.dumps(plain(value), sort_keys=True, allow_nan=False, ensure_ascii=False, indent=2) + "\n"


def write_report(path: str, value) -> None:
    """A report of aggregates, on the driver."""
    Path(path).write_text(report_json(value), encoding="utf-8")


def library_versions(*names: str) -> dict[str, str]:
    """Versions of the installed libraries named, and of Python."""
    found = {"python": platform.python_version()}
    for name in names:
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = "absent"
    return found


def manifest(files: DataFrame, versions: dict[str, str], most: int = 10_000) -> dict:
    """Digests of input files and the versions of libraries, as one report; of more than `most` files write digests() as a table."""
    rows = files.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files")
    return {"files": {r.name: {"bytes": r.bytes, "sha256": r.sha256, "md5": r.md5} for r in rows}, "versions": versions}


def markdown_table(df: DataFrame, rows: int = 200) -> str:
    """A report table of a small aggregate; of a longer one its first rows, and a line that says so."""
    found = df.limit(rows + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:rows]]
    more = [f"\nThe first {rows} rows; the table has them all."] if len(found) > rows else []
    return "\n".join([head, *lines, *more]) + "\n"
