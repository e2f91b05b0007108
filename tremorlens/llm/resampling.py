"""Operator 13: target-distribution importance resampling over word tries.

Each task walks the words of its texts through a trie whose nodes hold how often their run of words occurred and the
CRC-32 of it; a child's CRC goes on from that of its parent, so no run is ever put together. A trie is turned into
totals of the hash buckets and begun anew before it grows beyond NODES. The totals of all tasks are added up by
Spark, for the corpus and for the target texts; a bucket's gain is the log ratio of its two shares. Documents are then
scored by walking such paths again, with the gain attached to each node, and drawn without replacement by the largest
score with Gumbel noise from a hash of the identifier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import numbered_rows
from .common import documents, findable, materialize, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Nodes of a trie before it is begun anew: bounds memory, changes no result.
NODES = 1_000_000
#: Buckets whose totals travel in one row.
CHUNK = 50
#: A-Z become a-z; what is neither a digit, a-z nor part of a character beyond ASCII becomes a blank.
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie:
    """Runs of 1 to `most` words. Nodes are numbers; `words` and `runs` are their edges, from the root and from a node."""

    def __init__(self, most: int, gains: list[int] | None = None):
        self.most, self.gains = most, gains
        self.crc: list[int] = []
        self.gain: list[int] = []
        self.text: list[bytes] = []
        self.words, self.runs = _Words(self), _Runs(self)

    def add(self, crc: int, word: bytes) -> int:
        self.crc.append(crc)
        self.text.append(word)
        if self.gains is not None:
            self.gain.append(self.gains[crc % len(self.gains)])
        return len(self.crc) - 1

    def walk(self, words: list[bytes]) -> list[int]:
        """The nodes of all runs of a text, those of one word first."""
        first = list(map(self.words.__getitem__, words))
        out, ends = first, first
        for k in range(1, min(self.most, len(words))):
            ends = list(map(self.runs.__getitem__, zip(ends, first[k:])))
            out = out + ends
        return out


class _Words(dict):
    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.add(crc32(word), word)
        return node


class _Runs(dict):
    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, edge: tuple[int, int]) -> int:
        t = self.trie
        word = t.text[edge[1]]
        node = self[edge] = t.add(crc32(word, crc32(b" ", t.crc[edge[0]])), word)
        return node


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes]]:
    """Words of each text; null has none."""
    for t in batch.column(name).cast(pa.binary()).to_pylist():
        yield t.translate(SEPARATED).split(b" ") if t else []


def _words(parts: list[bytes]) -> list[bytes]:
    return [w for w in parts if w]


def bucket_totals(docs: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; `buckets` numbers reach the driver, whatever the table's size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, seen, held = np.zeros(buckets, np.int64), Trie(most), [], 0

        def flush():
            count = np.bincount(np.concatenate(seen), minlength=len(trie.crc)) if seen else np.zeros(0, np.int64)
            np.add.at(totals, np.array(trie.crc, np.int64) % buckets, count)
            seen.clear()

        for b in batches:
            for parts in _texts(b, "t"):
                seen.append(np.array(trie.walk(_words(parts)), np.int64))
                held += len(seen[-1])
                if len(trie.crc) > NODES or held > 4 * NODES:
                    flush()
                    held = 0
                    if len(trie.crc) > NODES:
                        trie = Trie(most)
        flush()
        pad = np.concatenate([totals, np.zeros(-buckets % CHUNK, np.int64)]).reshape(-1, CHUNK)
        keep = np.flatnonzero(pad.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(pad[keep].tolist(), pa.list_(pa.int64()))], ["at", "c"])

    parts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(of, "at int, c array<long>")
    rows = parts.groupBy("at").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(CHUNK)]).alias("c")).collect()
    out = np.zeros(buckets + -buckets % CHUNK, np.int64)
    for r in rows:
        out[r["at"] * CHUNK : (r["at"] + 1) * CHUNK] = r["c"]
    return out[:buckets]


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Floored thousandfold log ratio of the smoothed shares of each bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())]


def _noise(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the identifier, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: id_col, n_features, weight, score, rank (of those drawn, from 1; null for the others).

    Features are runs of 1 to `most` words. Null and blank texts have none and weigh 0. Of the rows with at least
    `least_words` words, `percent` of a hundred (rounded down) are drawn by score, ties to the smaller identifier, null
    identifiers last; a null identifier hashes like an empty one. Repeated rows are rows of their own and take
    neighbouring ranks. Without target texts every share of the target is alike. An empty table gives an empty result;
    other columns are ignored.
    """
    findable(docs.sparkSession)
    gain = gains(bucket_totals(docs, text_col, most, buckets), bucket_totals(target, target_col, most, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket
    slim = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(most, shared.value)
        for b in batches:
            sizes, features, weights = [], [], []
            for parts in _texts(b, "t"):
                words = _words(parts)
                nodes = trie.walk(words)
                sizes.append(len(words))
                features.append(len(nodes))
                weights.append(sum(map(trie.gain.__getitem__, nodes)) // len(nodes) if nodes else 0)
                if len(trie.crc) > NODES:
                    trie = Trie(most, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("i"), *[pa.array(x, pa.int64()) for x in (sizes, features, weights)]], ["i", "w", "n_features", "weight"])

    kind = slim.schema["i"].dataType.simpleString()
    weighed = slim.mapInArrow(of, f"i {kind}, w long, n_features long, weight long").withColumn("score", F.col("weight") + _noise(F.col("i"), seed))
    enough = F.col("w") >= least_words
    weighed = materialize(weighed.withColumn("late", ~enough), "weighed")
    drawn = weighed.where(~F.col("late")).count() * percent // 100
    ranked = numbered_rows(weighed, [F.col("late"), F.desc("score"), F.asc_nulls_last("i"), F.col("n_features")], "rank")
    return ranked.select(F.col("i").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WORD_LISTS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_STEP = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"

#: CRC-32 by its rule: a table of 256 remainders, then a fold over the bytes of each distinct word.
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORD_LISTS} AS words FROM documents), b AS (SELECT {_WORD_LISTS} AS words FROM benchmark),
r AS (SELECT n, 0 AS k, CAST(n AS BIGINT) AS c FROM range(256) t(n) UNION ALL SELECT n, k + 1, {_STEP.format(c='c')} FROM r WHERE k < 8),
remainders AS (SELECT list(c ORDER BY n) AS tab FROM r WHERE k = 8),
w AS (SELECT word, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM
  (SELECT unnest(words) AS word, 0 AS side FROM d UNION ALL SELECT unnest(words), 1 FROM b) u GROUP BY 1),
hexed AS (SELECT word, s, t, hex(encode(word)) AS h FROM w),
v AS (SELECT word, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h), 2), lambda i: CAST(('0x' || substr(h, i + 1, 2)) AS BIGINT))),
  lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM hexed, remainders),
g AS (SELECT bucket, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM v GROUP BY 1),
a AS (SELECT CAST(sum(s) AS BIGINT) AS sa, CAST(sum(t) AS BIGINT) AS ta FROM g),
gain AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * (sa + 10000) AS DOUBLE) / CAST((s + 1) * (ta + 10000) AS DOUBLE))) AS gain FROM g, a),
f AS (SELECT doc_id, sum(gain.gain) AS total FROM (SELECT doc_id, unnest(words) AS word FROM d) o JOIN v USING (word) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(words) AS n_features, CAST(coalesce(floor(total / nullif(len(words), 0)), 0) AS BIGINT) AS weight,
  CAST(('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN f USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM z
"""
