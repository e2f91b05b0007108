"""Column helpers that parse and normalise text. A value that doesn't parse becomes null, never an error."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(?i)\A[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\z"


def normalize(c: Column) -> Column:
    """Strip outer white space (Unicode); empty becomes null; the words None and NA are kept."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def raw_text(c: Column) -> Column:
    """The value as text; null stays null."""
    return c.cast("string")


def blank_as_missing(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("<missing>"))


def missing_word(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("<missing>"))


def safe_double(c: Column) -> Column:
    """Number or null. Java's own spellings (1.0d, NaN) are refused."""
    text = normalize(c)
    spelled = F.regexp_replace(text, r"(?i)inf(inity)?$", "Infinity")
    return F.when(text.rlike(NUMBER), spelled.try_cast("double"))


def iso_timestamp(c: Column) -> Column:
    """ISO date or timestamp, else null."""
    text = normalize(c)
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def usable_intensity(c: Column) -> Column:
    """Finite and positive (NaN compares above everything, so finiteness comes first)."""
    return finite(c) & (c > 0)


def fractional(c: Column) -> Column:
    return c % 1 != 0


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def numbered(form: str, *parts: Column) -> Column:
    """Identifier from a printf form; never cuts long numbers. Null if any part is."""
    whole = F.concat(*[p.cast("string") for p in parts])
    return F.when(whole.isNotNull(), F.format_string(form, *parts))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed dictionary; a key that it lacks gives null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def at_least(c: Column, least: int) -> Column:
    """0 or 1, null for null."""
    return (c >= least).cast("int")


def group_name(ids: Column, prefix: str = "site_") -> Column:
    """Name of a set of identifiers that doesn't depend on their order."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 20))


def big_endian(content: Column, start: int, size: int) -> Column:
    """Unsigned integer in bytes start.. (from 1) of a binary column."""
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("long")


def spelled(c: Column) -> Column:
    """A double in its shortest decimal spelling: plain from 0.0001 to below 10**16 (with .0 for whole numbers), else with a signed two-digit exponent."""
    number = c.cast("double")
    size, text = F.abs(number), number.cast("string")
    plain = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    sign = F.when(text.contains("E-"), F.lit("e-")).otherwise(F.lit("e+"))
    short = F.concat(F.regexp_replace(F.regexp_extract(text, r"^([^E]*)E", 1), r"\.0$", ""), sign, F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    special = F.when(F.isnan(number), "nan").when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
    return F.coalesce(special, F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), F.when(size == 0, text).otherwise(plain)).otherwise(short))


def cell_text(df: DataFrame, column: str) -> Column:
    """A cell as text: null stays null, dates and times ISO, doubles as spelled(), truth as True and False, the rest as it is."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind in ("timestamp", "timestamp_ntz"):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    return spelled(c) if kind in ("double", "float") else c.cast("string")


def strict_double(c: Column) -> Column:
    """Number of a cell that must hold one or be blank; any other text is an error."""
    text = normalize(c)
    number = safe_double(c)
    return F.when(text.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(number)


def without_prefix(c: Column, prefix: str) -> Column:
    """The text after the prefix, if it has it, else the whole text."""
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def zero_filled(c: Column, width: int) -> Column:
    """A whole number's text padded with zeros, after its sign; longer ones stay whole."""
    text = c.cast("string")
    sign = F.regexp_extract(text, r"^[+-]?", 0)
    digits = F.substr(text, F.length(sign) + 1)
    return F.concat(sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(width) - F.length(sign)), F.lit("0")))
