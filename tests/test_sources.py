import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tremorlens.operators import proximity
from tremorlens.sources import acquisition, binary, markup, rasters, sinks, tables, vectors
from tremorlens.streaming.rates import windowed_rates


def workbook(cells: dict[str, str], red: str = "") -> bytes:
    out = io.BytesIO()
    rows = {}
    for at, xml in cells.items():
        rows.setdefault(int("".join(c for c in at if c.isdigit())), []).append(xml)
    sheet = "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items())
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font/><font><color rgb="FFFF0000"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def text(at, value, style=0):
    return f'<c r="{at}" t="inlineStr" s="{style}"><is><t>{value}</t></is></c>'


def files(spark, folder):
    return tables.read_files(spark, str(folder))


def test_workbook(spark, tmp_path):
    good = {"A1": text("A1", "a"), "C1": text("C1", "c"), "A2": text("A2", "x", 1), "C4": '<c r="C4"><v>2.5</v></c>'}
    (tmp_path / "b.xlsx").write_bytes(workbook(good))
    got = binary.read_workbook(files(spark, tmp_path), "S", ["a", "Unnamed: 1", "c"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(2, "x", None, None), (4, None, None, "2.5")]
    assert [r.rows for r in binary.empty_rows(binary.read_cells(files(spark, tmp_path))).collect()] == [[3]]
    assert [(r.row, r.col) for r in binary.read_cells(files(spark, tmp_path)).where("red").collect()] == [(2, 1)]
    with pytest.raises(ValueError, match="header"):
        binary.read_workbook(files(spark, tmp_path), "S", ["a", "b", "c"])
    (tmp_path / "b.xlsx").write_bytes(workbook(good | {"A3": '<c r="A3"><f>1+1</f><v>2</v></c>'}))
    with pytest.raises(ValueError, match="formula"):
        binary.read_workbook(files(spark, tmp_path), "S", ["a", "Unnamed: 1", "c"])


def test_several_workbooks(spark, tmp_path):
    for name, value in (("a", "x"), ("b", "y")):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook({"A1": text("A1", "h"), "A2": text("A2", value)}))
    got = binary.read_workbook(files(spark, tmp_path), "S", ["h"])
    assert sorted((r.path.rsplit("/", 1)[1], r.source_row, r.h) for r in got.collect()) == [("a.xlsx", 2, "x"), ("b.xlsx", 2, "y")]
    (tmp_path / "b.xlsx").write_bytes(workbook({"A1": text("A1", "other"), "A2": text("A2", "y")}))
    with pytest.raises(ValueError, match="b.xlsx: header"):
        binary.read_workbook(files(spark, tmp_path), "S", ["h"])
    (tmp_path / "b.xlsx").write_bytes(workbook({"A1": text("A1", "h")}))
    with pytest.raises(ValueError, match="no records"):
        binary.read_workbook(files(spark, tmp_path), "S", ["h"])


def test_sheet_by_place(spark, tmp_path):
    cells = {"A1": text("A1", "title"), "A2": text("A2", "id"), "B2": text("B2", "height"), "B3": text("B3", "m"), "A4": text("A4", "1"), "B4": '<c r="B4" s="1"><v>2.5</v></c>', "A5": text("A5", "2"), "B5": '<c r="B5"><f>B4*2</f><v>5</v></c>'}
    (tmp_path / "b.xlsx").write_bytes(workbook(cells))
    found = binary.read_cells(files(spark, tmp_path))
    assert sorted(tuple(r)[1:] for r in binary.read_sheet(found, "S", 3).collect()) == [(4, "1", "2.5", None, True), (5, "2", "5", None, False)]
    assert sorted((r.column, r.source_header, r.source_units) for r in binary.sheet_dictionary(found, "S").collect()) == [("c001", "id", None), ("c002", "height", "m")]
    assert sorted((r.row, r.formula, r.red, r.value) for r in binary.source_cells(found).collect()) == [(4, None, True, "2.5"), (5, "B4*2", False, "5")]


def test_text_csv_keeps_words(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b\nc"\nNA,\n"None","x ""y"""\n')
    assert sorted(map(tuple, tables.read_text_csv(spark, str(tmp_path / "t.csv"), ["a", "b\nc"]).collect())) == [("NA", ""), ("None", 'x "y"')]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok/a.txt", "hello")
        z.writestr("../up.txt", "x")
        z.writestr("/abs.txt", "x")
    got = {r.member: (r.size, r.crc32, r.unsafe) for r in binary.zip_inventory(files(spark, tmp_path)).collect()}
    assert got["ok/a.txt"] == (5, zlib.crc32(b"hello"), False) and got["../up.txt"][2] and got["/abs.txt"][2]
    tar = tmp_path / "t"
    tar.mkdir()
    with tarfile.open(tar / "t.tar.gz", "w:gz") as t:
        for name, body in (("d/one.csv", b"1"), ("two.csv", b"22"), ("big.bin", b"0" * 10_000)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert {r.member: bytes(r.content) for r in binary.tar_members(files(spark, tar), ["one.csv", "two.csv"], 100).collect()} == {"d/one.csv": b"1", "two.csv": b"22"}
    with pytest.raises(Exception, match="more than"):
        binary.tar_members(files(spark, tar), ["none.csv"], 100).collect()
    with pytest.raises(Exception, match="incomplete, without .'none.csv'"):
        binary.tar_members(files(spark, tar), ["none.csv", "one.csv"]).collect()


@pytest.mark.parametrize("name", ["../escape.txt", "/tmp/escape.txt", "dir\\escape.txt"])
def test_unsafe_archives_are_refused(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok.txt", "fine")
        z.writestr(name, "bad")
    with pytest.raises(ValueError, match="Unsafe"):
        binary.zip_members(files(spark, tmp_path))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/ok.txt", "fine")
    (tmp_path / "n.zip").write_bytes(b"PK no archive")
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in binary.valid_zip(files(spark, tmp_path)).collect()} == {"z.zip": True, "n.zip": False}
    (tmp_path / "n.zip").unlink()
    assert [(r.member, bytes(r.content)) for r in binary.zip_members(files(spark, tmp_path), r".*\.txt").collect()] == [("a/ok.txt", b"fine")]


def test_downloads_are_whole_or_absent(tmp_path):
    source, out, ledger = tmp_path / "source.csv", tmp_path / "out", tmp_path / "ledger"
    source.write_bytes(b"a,b\n" * 1000)
    right = (("sha256", acquisition.file_digest(source)), ("md5", acquisition.file_digest(source, "md5")))
    good = acquisition.Wanted("good", source.as_uri(), "sub/good.csv", right)
    assert acquisition.fetch_all([good], str(out), str(ledger))["good"]["bytes"] == 4000
    assert sorted(p.name for p in (out / "sub").iterdir()) == ["good.csv", "good.csv.manifest.json"] and not ledger.exists()
    (tmp_path / "empty").write_bytes(b"")
    bad = [acquisition.Wanted("gone", (tmp_path / "none").as_uri(), "gone.csv"), acquisition.Wanted("empty", (tmp_path / "empty").as_uri(), "empty.csv"), acquisition.Wanted("changed", source.as_uri(), "changed.csv", (("md5", "0" * 32),))]
    with pytest.raises(ValueError, match="changed.*empty.*gone"):
        acquisition.fetch_all([*bad, good], str(out), str(ledger))
    assert sorted(p.name for p in ledger.iterdir()) == ["changed_failure.json", "empty_failure.json", "gone_failure.json"]
    assert (out / "changed.csv.part").exists() and not (out / "changed.csv").exists()
    assert json.loads((ledger / "changed_failure.json").read_text())["acquired"] is False
    pinned = {"sub/good.csv": right[0][1]}
    acquisition.verify_manifest(str(out), pinned, pinned)
    with pytest.raises(ValueError, match="incomplete"):
        acquisition.verify_manifest(str(out), {}, pinned)
    (out / "sub/good.csv").write_bytes(b"other")
    with pytest.raises(ValueError, match="digest"):
        acquisition.verify_manifest(str(out), pinned, pinned)


def test_registry(spark, tmp_path):
    (tmp_path / "r.yml").write_text("# events\nevents:\n  one_1999:\n    country: X\n    mw: 7.2  # moment\n\n  two_2003:\n    id: 'abc'\n")
    assert sorted(map(tuple, acquisition.read_registry(spark, str(tmp_path / "r.yml")).collect())) == [("one_1999", "country", "X"), ("one_1999", "mw", "7.2"), ("two_2003", "id", "abc")]


def shapefile(polygons):
    """(.shp, .dbf) bytes of polygons, each a list of rings."""
    body = b""
    for k, rings in enumerate(polygons, 1):
        flat = [p for r in rings for p in r]
        if flat:
            starts, n = [], 0
            for r in rings:
                starts.append(n)
                n += len(r)
            xs, ys = zip(*flat)
            shape = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        else:
            shape = struct.pack("<i", 0)
        body += struct.pack(">2i", k, len(shape) // 2) + shape
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, 0, 0, 9, 9, 0, 0, 0, 0)
    field = b"level".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    rows = b"".join(b" " + str(k).encode().ljust(4) for k in range(len(polygons)))
    return head + body, struct.pack("<B3sIHH20s", 3, b"\0" * 3, len(polygons), 65, 5, b"") + field + b"\x0d" + rows


def test_shapefiles(spark, tmp_path):
    square = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    shp, dbf = shapefile([[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)], [square(5.0, 5.0, 1.0)], [square(5.0, 5.0, 1.0)], [], [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    layer = tables.read_files(spark, str(tmp_path), "*.shp")
    shapes = vectors.read_shapes(layer)
    inside = shapes.withColumn("p", vectors.interior_point(F.col("rings")))
    rows = {r.feature: r for r in inside.select("feature", "p", proximity.in_rings(F.col("p.x"), F.col("p.y"), F.col("rings")).alias("ok")).collect()}
    assert [rows[k].ok for k in (1, 2, 3)] == [True] * 3 and rows[4].p is None and rows[5].p is None
    assert tuple(vectors.geometry_problems(shapes).first())[1:] == (5, 1, 1, 1)
    assert tuple(layer.select(vectors.layer_header(F.col("content")).alias("h")).first().h) == (5, 0.0, 0.0, 9.0, 9.0)
    assert sorted((r.feature, r.fields["level"]) for r in vectors.read_attributes(tables.read_files(spark, str(tmp_path), "*.dbf")).collect()) == [(k + 1, str(k)) for k in range(5)]


def tiff(pixels, nodata=None, tile=None, deflate=False):
    import numpy as np

    high, wide = pixels.shape
    blocks = [pixels[y : y + 2] for y in range(0, high, 2)]
    if tile:
        blocks = [np.pad(b := pixels[y : y + tile, x : x + tile], ((0, tile - b.shape[0]), (0, tile - b.shape[1]))) for y in range(0, high, tile) for x in range(0, wide, tile)]
    raw = [zlib.compress(b.tobytes()) if deflate else b.tobytes() for b in blocks]
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags = [(256, 3, [wide]), (257, 3, [high]), (258, 3, [8 * pixels.itemsize]), (259, 3, [8 if deflate else 1]), (277, 3, [1]), (339, 3, [kind])]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, [0] * len(raw)), (325, 4, list(map(len, raw)))] if tile else [(273, 4, [0] * len(raw)), (278, 3, [2]), (279, 4, list(map(len, raw)))]
    tags += [(33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 36.0, 38.0, 0.0])]
    tags += [(42113, 2, f"{nodata}\0".encode())] if nodata is not None else []
    tags.sort(key=lambda t: t[0])
    form = {2: "s", 3: "H", 4: "I", 12: "d"}
    for _ in (0, 1):  # the second time with the places of the blocks
        ifd, extra, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
        for tag, k, v in tags:
            data = v if k == 2 else struct.pack(f"<{len(v)}{form[k]}", *v)
            ifd += struct.pack("<HHI", tag, k, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(extra)))
            extra += data if len(data) > 4 else b""
        start, places = at + len(extra), []
        for r in raw:
            places.append(start)
            start += len(r)
        tags = [(t, k, places if t in (273, 324) else v) for t, k, v in tags]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + ifd + b"\0" * 4 + extra + b"".join(raw)


@pytest.mark.parametrize(("dtype", "tile", "deflate"), [("uint8", None, False), ("uint8", 4, True), ("float32", None, True), ("int16", 3, False)])
def test_rasters(spark, tmp_path, dtype, tile, deflate):
    import numpy as np

    pixels = (np.arange(35).reshape(5, 7) % 11).astype(dtype)
    if dtype == "float32":
        pixels[0, 0] = np.inf
    (tmp_path / "a.tif").write_bytes(tiff(pixels, 3, tile, deflate))
    found = tables.read_files(spark, str(tmp_path))
    head = rasters.raster_header(found).first()
    assert (head.columns, head.rows, head.bands, head.nodata, head.dx, head.left, head.top) == (7, 5, 1, 3.0, 0.5, 36.0, 38.0)
    blocks = rasters.raster_blocks(found)
    got = rasters.raster_statistics(blocks).first()
    ok = np.isfinite(pixels) & (pixels != 3)
    assert (got.valid, got.masked, got.least, got.largest) == (ok.sum(), (~ok).sum(), pixels[ok].min(), pixels[ok].max())
    assert got.histogram == ({int(v): int(n) for v, n in zip(*np.unique(pixels[ok], return_counts=True))} if dtype == "uint8" else None)
    assert blocks.count() == (-(-5 // tile) * -(-7 // tile) if tile else 3)


def test_kml(spark):
    kml = "<kml><Placemark><name>a</name><description>&lt;table&gt;&lt;tr&gt;&lt;td&gt;Key&lt;/td&gt;&lt;td&gt;v&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;</description></Placemark><GroundOverlay><LatLonBox><north>38.5</north><south>37</south><east> 37.2 </east><west>36</west></LatLonBox></GroundOverlay></kml>"
    r = spark.createDataFrame([(kml,)], "k string").select(markup.placemarks(F.col("k")).alias("p"), markup.placemark_tables(F.col("k")).alias("t"), markup.ground_overlays(F.col("k")).alias("o")).first()
    assert r.p == ["a"] and [[tuple(x) for x in t] for t in r.t] == [[("Key", "v")]] and [tuple(o) for o in r.o] == [(38.5, 37.0, 37.2, 36.0)]


def test_ddi_files_and_statistics(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<codeBook xmlns="ddi:codebook:2_5"><fileDscr ID="F1"><fileTxt><fileName>Building.sav</fileName><dimensns><caseQnty>120</caseQnty><varQnty>2</varQnty></dimensns></fileTxt></fileDscr>'
        '<dataDscr><var ID="V1" name="grade" files="F1 F2"><labl>Damage</labl><sumStat type="vald">17</sumStat><sumStat type="min"> 1 </sumStat></var><var ID="V2" name="other" files="F2"><labl>x</labl></var></dataDscr></codeBook>'
    )
    path = str(tmp_path / "d.xml")
    assert [tuple(r) for r in markup.ddi_files(spark, path).collect()] == [("F1", "Building.sav", 120, 2)]
    assert sorted(map(tuple, markup.ddi_statistics(spark, path).collect())) == [("grade", "min", "1"), ("grade", "vald", "17")]
    assert [r.variable for r in markup.ddi_variables(spark, path, "F1").collect()] == ["grade"]


def test_png_digest_and_checks(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + b"rest"
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.csv").write_bytes(b"x,y\n1,2\n")
    found = files(spark, tmp_path)
    heads = found.select(binary.png_header(F.col("content")).alias("h"), tables.sniff(F.col("content")).alias("k")).orderBy("k").collect()
    assert [r.k for r in heads] == ["csv", "png"] and heads[0].h is None and (heads[1].h.width, heads[1].h.height, heads[1].h.bit_depth, heads[1].h.colour_type) == (640, 480, 8, 2)
    want = spark.createDataFrame([("a.png", 1, len(png), None, True), ("b.csv", 100, None, None, True), ("c", 1, None, None, True), ("d", 1, None, None, False)], "name string, least_bytes long, exact_bytes long, md5 string, required boolean").withColumn("format", F.lit(None).cast("string"))
    statuses = tables.check_files(found, want)
    assert {r.name: r.status for r in statuses.collect()} == {"a.png": "ok", "b.csv": "too_small", "c": "missing", "d": "optional_missing"}
    with pytest.raises(ValueError, match="b.csv: too_small; c: missing"):
        tables.assert_files(statuses)
    other = tables.check_files(found, want.where("name = 'a.png'").withColumn("format", F.lit("pdf")))
    assert other.first().status == "wrong_format"
    texts = [(b'{"a": [1, 2]}',), (b'{"a": 1',), (b"[1]",), (b"%PDF-1",), (b" <x/>",)]
    assert [r[0] for r in spark.createDataFrame(texts, "c binary").select(tables.sniff(F.col("c"))).collect()] == ["json", "unknown", "json", "pdf", "markup"]
    assert set(sinks.manifest(tables.digests(found), {})["files"]) == {"a.png", "b.csv"}


def test_markup(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<codeBook xmlns="ddi:codebook:2_5"><dataDscr><var ID="V1" name="grade"><labl>Damage</labl><catgry missing="Y"><catValu>9</catValu><labl>None</labl><catStat>12</catStat></catgry><catgry><catValu>1</catValu><labl>G1</labl><catStat>5</catStat></catgry></var></dataDscr></codeBook>')
    got = markup.ddi_variables(spark, str(tmp_path / "d.xml")).collect()
    assert sorted((r.variable, r.value, r.category, r.frequency, bool(r.missing)) for r in got) == [("grade", "1", "G1", 5, False), ("grade", "9", "None", 12, True)]
    df = spark.createDataFrame([("<table><tr><td>Key</td><td><b>v</b></td></tr><TR><td>k2</td>\n<td>2</td></TR></table>",)], "h string")
    assert [tuple(p) for p in df.select(markup.html_pairs(F.col("h"))).first()[0]] == [("Key", "v"), ("k2", "2")]


def test_json_output():
    import pandas as pd

    text = sinks.report_json({"b": [float("inf"), float("nan"), pd.NA], "a": 2, "c": [1, 2], "ğ": None})
    assert json.loads(text) == {"a": 2, "b": [None, None, None], "c": [1, 2], "ğ": None} and text.endswith("\n") and "ğ" in text


def test_stream_of_files(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:20:00", "a", None), ("2024-01-01 01:20:00", "b", 0)], "t string, s string, g int").selectExpr("cast(t as timestamp) t", "s", "g")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "s", "g")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("rates").collect()) == sorted(tuple(r)[1:] for r in windowed_rates(rows, "t", "s", "g").collect())
