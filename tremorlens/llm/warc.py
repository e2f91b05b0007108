"""Operator 9: WARC records and a Merkle fixity audit.

Pages become WARC records with an offset in their file. Leaves hash a record with its offset range; each node
above hashes the ordered hashes and ranges of up to 16 nodes below, up to one root over all files. Two replicas
are compared from the roots down, and only branches that differ are opened, which leads to the damaged records.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Children of a node (a power of two), identifiers in a file, levels inside a file (16**3 leaves and more).
FAN, FILE, INNER = 16, 1024, 3
#: Files that pages without identifier are spread over.
UNNAMED = 4096


def warc_record(key: Column, url: Column, html: Column) -> Column:
    """One resource record, as text (its UTF-8 bytes are the record)."""
    line = F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")
    body = F.coalesce(html, F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), line))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), line]
    return F.concat(*head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def warc_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_id, _file, _seq, _offset, _length, _sha of each page's record: files of FILE identifiers, in order of these.

    Nulls count as empty; pages without identifier go to files of their own, by a hash. Repeated rows are records
    of their own.
    """
    key, url, html = (F.col(f"`{c}`") for c in (id_col, url_col, html_col))
    record = warc_record(key, url, html)
    rows = pages.select(
        key.alias("_id"), F.coalesce(F.floor(key / FILE), -1 - F.pmod(F.xxhash64(url, html), F.lit(UNNAMED))).cast("long").alias("_file"),
        F.octet_length(record).cast("long").alias("_length"), F.sha2(record, 256).alias("_sha"),
    )
    w = Window.partitionBy("_file").orderBy("_id", "_sha")
    return rows.withColumns({"_seq": F.row_number().over(w).cast("long") - 1, "_offset": F.coalesce(F.sum("_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})


def merkle_levels(index: DataFrame, low: int, high: int) -> list[DataFrame]:
    """Nodes of each level, leaves first: _file, _seq (place of the node), _hash, _start, _stop. Files run from low to high."""
    leaf = F.sha2(F.concat_ws(":", F.col("_offset"), F.col("_offset") + F.col("_length"), "_sha"), 256)
    levels = [index.select((F.col("_file") - low).alias("_file"), "_seq", leaf.alias("_hash"), F.col("_offset").alias("_start"), (F.col("_offset") + F.col("_length")).alias("_stop"))]
    span, depth = high - low + 1, 0
    while depth < INNER or span > 1:
        depth += 1
        below = levels[-1]
        file, seq = _parent(depth)
        if depth > INNER:
            span = -(-span // FAN)
        child = F.struct("_file", "_seq", "_hash", "_start", "_stop")
        nodes = below.groupBy(file.alias("_pfile"), seq.alias("_pseq")).agg(F.array_sort(F.collect_list(child)).alias("_c"))
        joined = F.concat_ws("|", F.transform("_c", lambda c: F.concat_ws(":", c["_start"], c["_stop"], c["_hash"])))
        levels.append(materialize(nodes.select(F.col("_pfile").alias("_file"), F.col("_pseq").alias("_seq"), F.sha2(joined, 256).alias("_hash"), F.array_min("_c._start").alias("_start"), F.array_max("_c._stop").alias("_stop")), "merkle"))
    return levels


def _parent(depth: int) -> tuple[Column, Column]:
    """Place, on level depth, of the node above one of level depth - 1: first within the file, then over files."""
    if depth <= INNER:
        return F.col("_file"), F.floor(F.col("_seq") / FAN).cast("long")
    return F.floor(F.col("_file") / FAN).cast("long"), F.lit(0).cast("long")


def damaged_leaves(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """_file, _seq (file counted from the lowest) of leaves that differ or that one replica lacks, found from the roots down."""
    place = ["_file", "_seq"]
    wrong = None
    for depth in range(len(ours) - 1, -1, -1):
        a, b = (x[depth].select(*place, "_hash") for x in (ours, theirs))
        if wrong is not None:
            file, seq = _parent(depth + 1)
            above = wrong.select(F.col("_file").alias("_pfile"), F.col("_seq").alias("_pseq"))
            a, b = (x.join(above, (file == F.col("_pfile")) & (seq == F.col("_pseq")), "left_semi") for x in (a, b))
        both = a.join(b.withColumnRenamed("_hash", "_other"), place, "full_outer")
        wrong = both.where(~F.col("_hash").eqNullSafe(F.col("_other"))).select(*place)
        if depth:
            wrong = materialize(wrong, "mismatch")
    return wrong


def fixity_audit(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each record: id_col, file, seq, offset, length, record_sha256, intact (in the replica), only_in_replica.

    A record that the replica lacks, or whose place in its file moved, is not intact; a place that only the replica
    fills is a row of its own. Identifiers are numbers. Empty tables give an empty result.
    """
    ours, theirs = (materialize(warc_index(x, id_col, url_col, html_col), "index") for x in (pages, replica))
    ends = ours.select("_file").unionByName(theirs.select("_file")).agg(F.min("_file"), F.max("_file")).first()
    low, high = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    wrong = damaged_leaves(merkle_levels(ours, low, high), merkle_levels(theirs, low, high))
    wrong = wrong.select((F.col("_file") + low).alias("_file"), "_seq", F.lit(True).alias("_bad"))
    place = ["_file", "_seq"]
    held = ours.join(wrong, place, "left").withColumn("_extra", F.lit(False))
    extra = theirs.join(wrong, place).join(ours, place, "left_anti").withColumn("_extra", F.lit(True))
    return held.unionByName(extra).select(
        F.col("_id").alias(id_col), F.col("_file").alias("file"), F.col("_seq").alias("seq"), F.col("_offset").alias("offset"),
        F.col("_length").alias("length"), F.col("_sha").alias("record_sha256"), F.col("_bad").isNull().alias("intact"), F.col("_extra").alias("only_in_replica"))


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a WARC file, plain or gzip (offsets are of the plain bytes)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", start)
        headers = dict(line.split(": ", 1) for line in data[start:stop].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        body = stop + 4
        end = body + int(headers["Content-Length"])
        yield start, end + 4 - start, headers, data[body:end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, url, type, record_sha256, block of all records of WARC files (any folder that Spark reads)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(path, a, n, h.get("WARC-Target-URI"), h.get("WARC-Type"), sha256(plain[a : a + n]).hexdigest(), block) for a, n, h, block in parse_warc(plain)]
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "url", "type", "record_sha256", "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, offset long, length long, url string, type string, record_sha256 string, block binary")


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is the table with the first character of some pages (by a hash of the identifier) overwritten."""
    pages = table(spark, sf_dir, "pages")
    hit = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2) == "00"
    replica = pages.withColumn("html", F.when(hit, F.concat(F.lit("?"), F.substring("html", 2, 2147483647))).otherwise(F.col("html")))
    return fixity_audit(pages, replica).drop("only_in_replica")


OP9_SQL = """
WITH p AS (
  SELECT 0 AS side, page_id, url, html FROM pages UNION ALL
  SELECT 1, page_id, url, CASE WHEN substr(md5(page_id::VARCHAR), 1, 2) = '00' THEN '?' || substr(html, 2) ELSE html END FROM pages
), r AS (
  SELECT side, page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS file, coalesce(html, '') AS body,
    regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') AS line FROM p
), d AS (SELECT *, md5(page_id::VARCHAR || '|' || line) AS dig FROM r), w AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' ||
    substr(dig, 1, 8) || '-' || substr(dig, 9, 4) || '-' || substr(dig, 13, 4) || '-' || substr(dig, 17, 4) || '-' || substr(dig, 21, 12) ||
    '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || line || chr(13) || chr(10) ||
    'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) ||
    body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM d
), h AS (SELECT side, page_id, file, strlen(record) AS length, sha256(record) AS record_sha256 FROM w), i AS (
  SELECT *, row_number() OVER q - 1 AS seq, coalesce(CAST(sum(length) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset"
  FROM h WINDOW q AS (PARTITION BY side, file ORDER BY page_id, record_sha256)
)
SELECT a.page_id, a.file, a.seq, a."offset", a.length, a.record_sha256,
  b.seq IS NOT NULL AND a."offset" = b."offset" AND a.length = b.length AND a.record_sha256 = b.record_sha256 AS intact
FROM (SELECT * FROM i WHERE side = 0) a LEFT JOIN (SELECT * FROM i WHERE side = 1) b ON a.file = b.file AND a.seq = b.seq
"""
