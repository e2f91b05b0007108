"""Operators 12 and 13 against their SQL and plain Python."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tremorlens.llm import collocations, common, resampling


@pytest.mark.parametrize(("query", "sql"), [(collocations.op12_collocations, collocations.OP12_SQL), (resampling.op13_importance_resampling, resampling.OP13_SQL)])
def test_equals_sql(query, sql, same):
    assert same(query, sql) > 0


def plain_collocations(rows, most, least, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and within(q) and 100 * b >= share * a for (o, q), b in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("chunk", "most", "top"), [(1 << 20, 4, 2000), (40, 4, 7), (1, 5, 2000), (300, 2, 3)])
def test_collocations_by_hand(spark, monkeypatch, chunk, most, top):
    """Chunks of any size count alike."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SHARE_OF", max(chunk, 100))
    rng = random.Random(most * 31 + top)
    words = ["a", "B", "b", "É", "é", "c\x00d", "the", "of", "x-y", "日本"]
    rows = [(" ".join(rng.choice(words[: rng.randint(1, 10)]) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t ", "fr"), ("the of the of the of", "und"), ("A B c\x00d e. A b C\x00D e", "en")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({c: F.lit("clash") for c in ("c", "seq", "n", "rank", "t")})
    got = collocations.collocations(docs, most=most, least=5, top=top).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, most, 5, 80, top) and len(got) > 3


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    """Counts whose product with the scale has more than 64 bits, and a remainder that doubles would lose."""
    a, l, r = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_997
    row = spark.createDataFrame([(2, [l, a], [r, a], a)], "k int, opening array<long>, ending array<long>, a long").select(collocations._cut(F.col("k"), F.col("opening"), F.col("ending"), F.col("a")).alias("c")).first().c
    assert (row.score, row.at, row.l, row.r) == (2_000_000 * a // (l + r), 1, l, r)


def test_packed_sequences_come_back():
    import numpy as np

    for seq in ([], [-1], [0, -1, 5, 1 << 27], list(range(-1, 3000))):
        columns = collocations._unpacked(collocations._packed(np.array(seq, np.int32), np.array(seq, np.int64) << 33))
        assert columns[0].tolist() == seq and columns[1].tolist() == [x << 33 for x in seq]


def plain_weights(docs, target, most, buckets):
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    bucket = lambda x: crc32(x.encode()) % buckets
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for key, text in docs:
        words, found = runs(text)
        weight = math.floor(sum(gain(bucket(x)) for x in found) / len(found)) if found else 0
        h = int(sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize(("most", "nodes"), [(1, 1_000_000), (3, 1_000_000), (2, 5)])
def test_resampling_by_hand(spark, monkeypatch, most, nodes):
    """Runs of several words, and tries begun anew all the time."""
    monkeypatch.setattr(resampling, "NODES", nodes)
    rng = random.Random(most)
    words = ["Alpha", "beta", "é", "日本", "x9", "Q-r", "the", "_", "1"]
    docs = [(k if k % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(1000, None), (1001, ""), (5, "repeated"), (5, "repeated")]
    target = ["alpha beta x9", None, "Beta alpha alpha the"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("i", "t", "w", "late", "_place", "rank")})
    rows = resampling.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), most=most, buckets=97, least_words=10, percent=30, seed=7).collect()
    want = plain_weights(docs, target, most, 97)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in rows), key=str) == sorted(((k, f, w, s) for k, _, f, w, s in want), key=str)
    enough = sorted((-s, k is None, k or 0) for k, n, _, _, s in want if n >= 10)
    drawn = sorted(((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in rows if r.rank is not None))
    assert [d[0] for d in drawn] == list(range(1, len(enough) * 30 // 100 + 1)) and [d[1:] for d in drawn] == enough[: len(drawn)]


def test_resampling_of_nothing(spark):
    empty, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(empty, one).collect() == []
    row = resampling.resample(one, empty).first()
    assert (row.n_features, row.rank) == (2, None)
