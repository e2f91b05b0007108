"""Inventories of archives, images and workbooks, from the bytes of files."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import big_endian

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "path string, sheet string, row int, col int, value string, formula string, kind string, red boolean"


def png_header(content: Column) -> Column:
    """width, height, bit_depth, colour_type from the first 33 bytes; null if these aren't a PNG's."""
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(ok, F.struct(
        big_endian(content, 17, 4).alias("width"), big_endian(content, 21, 4).alias("height"), big_endian(content, 25, 1).alias("bit_depth"), big_endian(content, 26, 1).alias("colour_type")))


def unsafe_member(name: Column) -> Column:
    """Whether an archive member would leave its folder: absolute, with a drive, a backslash or a parent step."""
    return name.startswith("/") | name.contains("\\") | name.rlike(r"^[A-Za-z]:") | name.rlike(r"(^|/)\.\.(/|$)")


def zip_inventory(files: DataFrame) -> DataFrame:
    """path, member, size, compressed, crc32, link, unsafe of every member of ZIP files."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(path, i.filename, i.file_size, i.compress_size, i.CRC, (i.external_attr >> 16) & 0o170000 == 0o120000) for i in z.infolist()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "compressed", "crc32", "link"])

    found = files.select("path", "content").mapInPandas(members, "path string, member string, size long, compressed long, crc32 long, link boolean")
    return found.withColumn("unsafe", unsafe_member(F.col("member")) | F.col("link"))


def assert_safe(inventory: DataFrame) -> None:
    """Raise if any member would leave the folder it is extracted to."""
    if bad := inventory.where("unsafe").orderBy("path", "member").first():
        raise ValueError(f"Unsafe archive member: {bad.member} in {bad.path}")


def zip_members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """path, member, content of the members of ZIP files whose names match; an archive with any unsafe member is refused before
    one is read. Members stay rows: nothing is written outside Spark's own stores."""
    assert_safe(zip_inventory(files))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir() and re.fullmatch(pattern, i.filename):
                            yield pd.DataFrame([(path, i.filename, z.read(i))], columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, member string, content binary")


def valid_zip(files: DataFrame) -> DataFrame:
    """path, valid: whether the bytes are a ZIP archive with a directory that can be read."""

    @F.pandas_udf("boolean")
    def valid(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: zipfile.is_zipfile(io.BytesIO(c)))

    return files.select("path", valid("content").alias("valid"))


def tar_members(files: DataFrame, names: list[str], most_bytes: int = 5_000_000) -> DataFrame:
    """path, member, content of the named regular files of gzip tar archives; reading stops when all are found, and
    fails once members of more than most_bytes were passed, or if one is absent when the archive ends."""
    wanted = set(names)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, read = [], 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as t:
                    for m in t:
                        read += m.size
                        if read > most_bytes:
                            raise ValueError(f"{path}: more than {most_bytes} bytes before all members were found")
                        if m.isfile() and m.name.rsplit("/", 1)[-1] in wanted:
                            rows.append((path, m.name, t.extractfile(m).read()))
                        if len(rows) == len(wanted):
                            break
                if len(rows) < len(wanted):
                    raise ValueError(f"{path}: incomplete, without {sorted(wanted - {r[1].rsplit('/', 1)[-1] for r in rows})}")
                yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, member string, content binary")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, row, column, value, formula, kind, red font) of each cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        red = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            fonts = [any((c.get("rgb") or "").upper().endswith("FF0000") for c in f.iter(SHEET + "color")) for f in styles.find(SHEET + "fonts") or []]
            red = [fonts[int(x.get("fontId", 0))] if fonts else False for x in styles.find(SHEET + "cellXfs") or []]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(SHEET + "sheet"):
            target = targets[s.get(RELATION + "id")].lstrip("/")
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(SHEET + "c"):
                kind, v, f = c.get("t", "n"), c.find(SHEET + "v"), c.find(SHEET + "f")
                value = v.text if v is not None else "".join(t.text or "" for t in c.iter(SHEET + "t")) if kind == "inlineStr" else None
                if kind == "s" and value is not None:
                    value = strings[int(value)]
                if value is None and f is None:
                    continue
                style = int(c.get("s", 0))
                reference = c.get("r")
                out.append((s.get("name"), int(re.sub(r"\D", "", reference)), _column(reference), value, f.text or "" if f is not None else None, "error" if kind == "e" else kind, bool(red[style]) if style < len(red) else False))
        return out


def read_cells(files: DataFrame) -> DataFrame:
    """One row for each cell of XLSX files, with formula and red font; pivot or filter it as a table needs."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, *c) for c in workbook_cells(content)], columns=["path", "sheet", "row", "col", "value", "formula", "kind", "red"])

    return files.select("path", "content").mapInPandas(cells, CELLS)


def read_workbook(files: DataFrame, sheet: str, header: list[str], first: int = 1) -> DataFrame:
    """Records of a sheet: path, source_row and the columns as text. The header row of every file must equal header (a
    blank one is `Unnamed: i`); formula and error cells are refused; empty rows are left out (see empty_rows); a file
    without a record is an error."""
    cells = read_cells(files).where(F.col("sheet") == sheet)
    heads = cells.where(F.col("row") == first).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    wide = F.greatest(F.lit(len(header)), F.array_max(F.map_keys("m")))
    names = F.transform(F.sequence(F.lit(1), wide), lambda k: F.coalesce(F.col("m")[k], F.concat(F.lit("Unnamed: "), (k - 1).cast("string"))))
    wanted = F.array(*[F.lit(h) for h in header])
    states = files.select("path").join(heads, "path", "left").join(cells.where(F.col("row") > first).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("formula").isNotNull() | (F.col("kind") == "error")).alias("bad")), "path", "left")
    problem = F.when(~names.eqNullSafe(wanted), F.concat(F.lit("header differs: "), F.coalesce(F.array_join(names, "|"), F.lit("")))).when(F.col("bad") > 0, F.lit("formula or error cells")).when(F.coalesce("n", F.lit(0)) == 0, F.lit("no records"))
    if wrong := states.select("path", problem.alias("problem")).where("problem is not null").orderBy("path").first():
        raise ValueError(f"{wrong.path}: {wrong.problem}")
    body = cells.where(F.col("row") > first)
    return body.groupBy("path", F.col("row").alias("source_row")).agg(*[F.max(F.when(F.col("col") == k + 1, F.col("value"))).alias(n) for k, n in enumerate(header)])


def empty_rows(cells: DataFrame, first: int = 1) -> DataFrame:
    """path, sheet, rows: numbers of the rows below the header, up to the last one used, that hold nothing."""
    used = cells.where(F.col("row") > first).groupBy("path", "sheet").agg(F.array_sort(F.collect_set("row")).alias("used"))
    return used.select("path", "sheet", F.array_except(F.sequence(F.lit(first + 1), F.array_max("used")), "used").alias("rows"))


def read_sheet(cells: DataFrame, sheet: str, wide: int, first: int = 4, prefix: str = "c") -> DataFrame:
    """path, source_row, c001 and so on as text (numbers and tokens as they are spelled), supplemented (whether a cell of the row
    has red font) of a sheet whose columns are known by their place. Rows without any value are left out."""
    body = cells.where((F.col("sheet") == sheet) & (F.col("row") >= first))
    columns = [F.max(F.when(F.col("col") == k, F.col("value"))).alias(f"{prefix}{k:03d}") for k in range(1, wide + 1)]
    return body.groupBy("path", F.col("row").alias("source_row")).agg(*columns, F.max("red").alias("supplemented"))


def sheet_dictionary(cells: DataFrame, sheet: str, header: int = 2, units: int = 3, prefix: str = "c") -> DataFrame:
    """path, column, source_header, source_units of the columns of such a sheet, by place."""
    rows = cells.where((F.col("sheet") == sheet) & F.col("row").isin(header, units))
    pick = lambda n: F.max(F.when(F.col("row") == n, F.col("value")))
    each = rows.groupBy("path", "col").agg(pick(header).alias("source_header"), pick(units).alias("source_units"))
    return each.select("path", F.format_string(f"{prefix}%03d", "col").alias("column"), "source_header", "source_units")


def source_cells(cells: DataFrame, first: int = 4) -> DataFrame:
    """Cells with a formula or in red font: path, sheet, row, col, formula, red, value (the cached one of a formula)."""
    return cells.where((F.col("row") >= first) & (F.col("formula").isNotNull() | F.col("red"))).select("path", "sheet", "row", "col", "formula", "red", "value")
