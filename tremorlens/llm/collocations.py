"""Operator 12: phrase collocations by hierarchical pair naming.

Texts are cut into chunks of about a million words whose words have numbers of their own; a chunk hands on each of its
words once, with a count. Words (and later pairs) of all chunks meet by shuffle; the frequent ones get a global name,
the smallest (chunk, number) that they have anywhere, and go back to their chunks. A chunk then replaces neighbouring
names by pairs: a run of k words is the pair of the names of its first and its last k-1 words, and only runs whose
halves are frequent are looked at. Its distinct pairs travel in packs, one for each share of all pairs, as compressed
columns. The pairs are parent pointers too: counts of all openings and endings of a phrase, and the phrases inside it,
are read off its parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, findable, materialize, partitions, release_shuffles

MOST_WORDS, LEAST, SHARE, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Words of a chunk; it ends with a text, so a longer text makes a longer chunk.
CHUNK = 1 << 20
#: Bits of a name: the chunk's partition above, then its number in it, then the number within the chunk.
CHUNK_BITS, LOCAL_BITS = 13, 28
#: A-Z become a-z, marks that end a piece a line feed, tabs blanks.
CLEANED = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
END, NONE = -1, -2


class _Numbers(dict):
    """Numbers of words, given in the order of their first use."""

    def __init__(self, fresh: Iterator[int]):
        super().__init__({b"\n": END, b"": NONE})
        self.fresh = fresh

    def __missing__(self, word: bytes) -> int:
        n = self[word] = next(self.fresh)
        return n


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, compressed: each column's bytes of one significance together, with the width and length in front."""
    out = []
    for c in columns:
        data = pa.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(c) else b""
        out += [c.itemsize.to_bytes(1), len(c).to_bytes(8), len(data).to_bytes(8), data]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        wide, n, size = data[at], int.from_bytes(data[at + 1 : at + 9]), int.from_bytes(data[at + 9 : at + 17])
        planes = pa.decompress(data[at + 17 : at + 17 + size], wide * n, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, n).T).view(f"<i{wide}").ravel())
        at += 17 + size
    return out


def _dense(seq: np.ndarray) -> np.ndarray:
    """One END between runs of what goes on."""
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] >= 0) | (seq[:-1] >= 0)
    return seq[keep]


WORDS = "c long, seq binary, lang string, word binary, at int, n long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as rows (c, seq), and the distinct words of each as rows (c, lang, word, at, n)."""
    schema = pa.schema([("c", pa.int64()), ("seq", pa.binary()), ("lang", pa.string()), ("word", pa.binary()), ("at", pa.int32()), ("n", pa.int64())])
    task, chunks = TaskContext.get().partitionId(), count()
    fresh, known, held, size = count(), {}, [], 0

    def batch(c, **columns):
        n = len(next(iter(columns.values())))
        columns["c"] = [c] * n
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def closed():
        number = next(chunks)
        if number >> CHUNK_BITS or size >> LOCAL_BITS:
            raise ValueError("too many words in one partition; read the table in smaller ones")
        c, seq = task << CHUNK_BITS | number, np.concatenate(held)
        times = np.bincount(seq[seq >= 0], minlength=1)
        yield batch(c, seq=[_packed(_dense(seq))])
        for lang, numbers in known.items():
            words = [w for w, k in numbers.items() if k >= 0]
            if words:
                at = np.fromiter((numbers[w] for w in words), np.int32, len(words))
                yield batch(c, lang=[lang] * len(words), word=words, at=at, n=times[at])

    for b in batches:
        for text, lang in zip(b.column("t").cast(pa.binary()).to_pylist(), b.column("l").to_pylist()):
            if not text:
                continue
            parts = text.translate(CLEANED).replace(b"\n", b" \n ").split(b" ")
            numbers = known.setdefault(lang, None) or known.__setitem__(lang, _Numbers(fresh)) or known[lang]
            seq = np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))
            held.append(np.append(seq[seq != NONE], np.int32(END)))
            size += len(held[-1])
            if size >= CHUNK:
                yield from closed()
                fresh, known, held, size = count(), {}, [], 0
    if held:
        yield from closed()


PAIRS = "c long, seq binary, p int, pairs binary"
#: Words of all texts for each share of the pairs: a share is counted in one task at a time.
SHARE_OF = 1 << 19


def _pairs(key: tuple, names: pa.Table, chunk: pa.Table, shares: int) -> pa.Table:
    """Neighbouring names of a chunk: its runs that are one word longer as (c, seq), and its distinct pairs as (c, p, pairs),
    a pack for each share p: number in the chunk (from the one before), names of both, count."""
    schema = pa.schema([("c", pa.int64()), ("seq", pa.binary()), ("p", pa.int32()), ("pairs", pa.binary())])
    if not chunk.num_rows or not names.num_rows:
        return schema.empty_table()
    seq = _unpacked(chunk.column("seq")[0].as_py())[0]
    if names.column("ids").null_count:  # words come one a row
        at, ids = names.column("at").to_numpy(), names.column("id").to_numpy()
    else:
        packs = [_unpacked(x) for x in names.column("ids").to_pylist()]
        at, ids = (np.concatenate([x[i] for x in packs]) for i in range(2))
    own = np.full(int(max(seq.max(), at.max())) + 1, END, np.int32)
    order = np.argsort(at)
    own[at[order]] = np.arange(len(at), dtype=np.int32)
    ids = ids[order]
    seq = np.where(seq >= 0, own[seq], END)
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    both = (a >= 0) & (b >= 0)
    pair, new, times = np.unique(a[both] << 32 | b[both], return_inverse=True, return_counts=True)
    out = np.full(len(a), END, np.int32)
    out[both] = new
    left, right = ids[pair >> 32], ids[pair & 0xFFFFFFFF]
    share = ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) % np.uint64(shares)
    order = np.argsort(share, kind="stable")
    cut = np.flatnonzero(np.diff(share[order].astype(np.int64), prepend=-1))
    packs = [_packed(np.diff(k, prepend=0).astype(np.int32), left[k], right[k], times[k].astype(np.int32)) for k in np.split(order, cut[1:]) if len(k)]
    columns = [[_packed(_dense(out)), *[None] * len(packs)], [None, *share[order[cut]].astype(np.int32).tolist()], [None, *packs]]
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * (1 + len(packs)), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)


NAMES = "c long, ids binary, id long, a long, l long, r long"


def _counted(key: tuple, packs: pa.Table, least: int) -> pa.Table:
    """The frequent pairs of a share: rows (id, a, l, r), and for each chunk that has some (c, ids), a pack of numbers in the
    chunk and names."""
    schema = pa.schema([("c", pa.int64()), ("ids", pa.binary()), ("id", pa.int64()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64())])
    parts = [(c, *_unpacked(p)) for c, p in zip(packs.column("c").to_pylist(), packs.column("pairs").to_pylist())]
    own = np.concatenate([p[0] << LOCAL_BITS | np.cumsum(p[1], dtype=np.int64) for p in parts])
    left, right, times = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    order = np.lexsort((own, right, left))
    left, right, own, times = left[order], right[order], own[order], times[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    total = np.add.reduceat(times, first)
    size, many = np.diff(np.append(first, len(own))), total >= least
    head, keep = first[many], np.repeat(many, size)
    n = len(head)
    named = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *[pa.array(x) for x in (own[head], total[many], left[head], right[head])]]
    ids, own = np.repeat(own[first], size)[keep], own[keep]
    by = np.argsort(own, kind="stable")
    ids, chunk, at = ids[by], own[by] >> LOCAL_BITS, (own[by] & ((1 << LOCAL_BITS) - 1)).astype(np.int32)
    cut = np.flatnonzero(np.diff(chunk, prepend=-1))
    back = [_packed(at[k], ids[k]) for k in np.split(np.arange(len(at)), cut[1:]) if len(k)]
    m = len(back)
    sent = [pa.array(chunk[cut], pa.int64()), pa.array(back, pa.binary()), *[pa.nulls(m, pa.int64())] * 4]
    return pa.concat_tables([pa.Table.from_arrays(named, schema=schema), pa.Table.from_arrays(sent, schema=schema)])


def _named(words: DataFrame, least: int) -> DataFrame:
    """c, at and id of the frequent of rows (c, at, lang, word, n): the smallest (c, at) of those with the same word. In the
    row which that is of, also `a` (the sum of n) and the word.

    A word has one row for each chunk at most, so a group is at most a few millionths of all words.
    """
    keys = ["lang", "word"]
    own = F.shiftleft("c", LOCAL_BITS) + F.col("at")
    w = Window.partitionBy(*keys)
    found = words.repartition(*keys).withColumns({"a": F.sum("n").over(w), "id": F.min(own).over(w)}).where(F.col("a") >= least)
    return materialize(found.select("c", "at", "id", F.lit(None).cast("binary").alias("ids"), *[F.when(F.col("id") == own, F.col(k)).alias(k) for k in ("a", *keys)]), "names", "zstd")


def _once(named: DataFrame) -> DataFrame:
    """A row for each name."""
    return named.where(F.col("a").isNotNull()).drop("c", "at", "ids")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to `most` words that occur `least` times, and the words of each language (lang, n).

    Of a phrase: lang, phrase, k (its words), id, a, opening and ending (counts of its first and last 1 to k words),
    inner (its shorter phrases, as structs of k and id).
    """
    text, lang = F.col(f"`{text_col}`").alias("t"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("l")
    chunks = materialize(docs.select(text, lang).mapInArrow(_words, WORDS), "words", "zstd")
    words = chunks.where("word is not null")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    shares = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // SHARE_OF))
    names = _named(words.select("c", "at", "lang", "word", "n"), least)
    release_shuffles(docs.sparkSession)
    one, word = F.array(F.col("a")), F.col("word").cast("string")
    level = materialize(_once(names).select("id", "a", "lang", word.alias("phrase"), word.alias("last"), one.alias("opening"), one.alias("ending"), F.expr("cast(array() as array<struct<k:int,id:bigint>>)").alias("inner")), "phrases")
    found = None
    for k in range(2, most + 1):
        # Words and packs are counted: only the sequences stay on disk beside what is shuffled and written next.
        runs = materialize(chunks.where("seq is not null").select("c", "seq"), "runs")
        discard(chunks)
        sides = names.where("c is not null").select("c", "at", "id", "ids").groupBy("c"), runs.groupBy("c")
        done = [runs, names]
        chunks = materialize(sides[0].cogroup(sides[1]).applyInArrow(lambda key, n, c: _pairs(key, n, c, shares), PAIRS), "pairs")
        for table in done:
            discard(table)
        release_shuffles(docs.sparkSession)
        packs = chunks.where("seq is null").select("c", "p", "pairs").groupBy("p")
        names = materialize(packs.applyInArrow(lambda key, t: _counted(key, t, least), NAMES), "names").withColumn("at", F.lit(None).cast("int"))
        left = level.select(F.col("id").alias("l"), "lang", "phrase", "opening", F.col("inner").alias("left_inner"))
        right = level.select(F.col("id").alias("r"), "last", "ending", F.col("inner").alias("right_inner"))
        inner = F.array_distinct(F.concat("left_inner", "right_inner", *([F.array(*[F.struct(F.lit(k - 1).alias("k"), F.col(x).alias("id")) for x in "lr"])] if k > 2 else [])))
        level = materialize(_once(names).join(left, "l").join(right, "r").select(
            "id", "a", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("opening", one).alias("opening"), F.concat("ending", one).alias("ending"), inner.alias("inner")), "phrases")
        each = level.drop("last").withColumn("k", F.lit(k))
        found = each if found is None else found.unionByName(each)
    discard(chunks)
    discard(names)
    return found, totals


def _cut(k: Column, opening: Column, ending: Column, a: Column) -> Column:
    """The cut of the lowest score, the smallest place first: struct of score, at, l, r."""
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  a product with SCALE passes 64 bits
    l, r = (lambda i: F.element_at(opening, i)), (lambda i: F.element_at(ending, k - i))
    score = lambda i: F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide(a), wide(l(i)) + wide(r(i)))
    return F.array_min(F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.struct(score(i).alias("score"), i.alias("at"), l(i).alias("l"), r(i).alias("r"))))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first `top` phrases of each language (null: und).

    Null, empty and blank texts have no words. Every row counts, repeated ones too. A phrase is dropped if a longer
    one that holds it occurs in `share` of a hundred of its places or more. Other columns of docs are ignored; an empty
    table gives an empty result.
    """
    findable(docs.sparkSession)
    found, totals = phrases(docs, text_col, lang_col, most, least)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    longer = found.select(F.explode("inner").alias("p"), "a").groupBy("p.k", "p.id").agg(F.max("a").alias("longest"))
    kept = found.join(longer, ["k", "id"], "left").where(F.col("longest").isNull() | (100 * wide("longest") < share * wide("a")))
    cut = _cut(F.col("k"), F.col("opening"), F.col("ending"), F.col("a"))
    scored = kept.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a language's phrases, then the first of these.
    dealt = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS g FROM w),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY 1, 2), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= 30),
k AS (SELECT c.lang, c.g, c.a, i, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:i] JOIN f y ON y.lang = c.lang AND y.g = c.g[i + 1:len(c.g)]),
best AS (SELECT lang, g, a, arg_min({'l': l, 'r': r, 'score': score}, (score, i)) AS b FROM k GROUP BY 1, 2, 3),
inner_of AS (SELECT lang, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g, a FROM c),
longest AS (SELECT lang, g, max(a) AS longest FROM inner_of GROUP BY 1, 2),
s AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.b.l AS l, b.b.r AS r, b.b.score AS score FROM best b LEFT JOIN longest o ON o.lang = b.lang AND o.g = b.g
  WHERE o.longest IS NULL OR 100 * CAST(o.longest AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
