"""Operator 10: toxicity with a counterfactual-regularised classifier.

Logistic regression on the distinct words of a text and on their openings. Every sentence of a labelled text that names
an identity is also scored with the term swapped for others of its set; the squared change of the score is part of the
loss, so that a neutral mention of one group scores like that of another, and the terms can't carry the label. Weights
are never below 0: words only add to a score, so that much harmless text doesn't drown an insult; in return a longer
text never scores lower than a part of it.

Fit: labels are picked by a hash of the identifier, about PER_CLASS of each class. Features of the picked texts are
counted and chosen by Spark; only the counts of the chosen ones come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, table
from .langid import held_out

#: Bounds of the fit: about so many labelled documents of each class, features kept, sentences of a text that are
#: swapped, swaps of each, and distinct swaps in all (those of the smallest hashes, where there are more).
PER_CLASS, FEATURES, SENTENCES, SWAPS, PAIRS = 4000, 3000, 8, 3, 4000
#: Features are told apart by 22 bits of a hash; words are also known by openings of so many letters.
SPACE, OPENINGS = 22, (4, 5, 6)
#: Weights of the swap penalty (of the mean squared change of the score), of L2 and of L1.
SWAP, L2, L1 = 4.0, 1e-6, 1e-5
ROUNDS = 600
#: Words whose scores a worker remembers, and characters of a text taken at a time.
CACHE, CHARS = 400_000, 1 << 22
WORD = regex.compile(r"\w+")
SENTENCE = regex.compile(r"[^.!?\n]+")
# Sets of identity terms, each swapped for others of its set (neutral words for groups of people).
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("immigrants", "refugees", "foreigners", "africans", "asians", "europeans", "americans", "arabs", "latinos"),
    ("gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual"),
    ("disabled", "deaf", "blind", "elderly", "young", "teenagers"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
OTHERS = {t: [x for x in terms if x != t] for terms in IDENTITIES for t in terms}


def features(word: str) -> list[int]:
    """Hashed features of one lower-cased word: itself and its openings."""
    mask = (1 << SPACE) - 1
    return [crc32(f"={word}".encode("utf-8", "replace")) & mask, *(crc32(f"{n}{word[:n]}".encode("utf-8", "replace")) & mask for n in OPENINGS if len(word) >= n)]


def words(text: str) -> set[str]:
    """Distinct lower-cased words of a whole text."""
    if len(text) <= CHARS:
        return set(WORD.findall(text.lower()))
    return {m.group() for m in WORD.finditer(text.lower())}


@lru_cache(maxsize=300_000)
def _features(word: str) -> tuple[int, ...]:
    return tuple(features(word))


def counted(text: str) -> Counter:
    """How many distinct words have each feature."""
    out: Counter = Counter()
    for w in words(text):
        out.update(_features(w))
    return out


def swapped(text: str, sentences: int = SENTENCES, swaps: int = SWAPS) -> list[tuple[str, str]]:
    """(sentence, the same with a term swapped), lower-cased: of the sentences that name an identity, those of the
    smallest hashes, each distinct one once, and for each term in it the next terms of its set from a place the hash gives."""
    low = text.lower()
    if not any(t in low for t in OTHERS):
        return []
    found: dict[str, list[str]] = {}
    for m in SENTENCE.finditer(low):
        if terms := sorted({w for w in WORD.findall(m.group()) if w in OTHERS}):
            found[m.group().strip()] = terms
    out = []
    for mark, sentence in sorted((crc32(s.encode("utf-8", "replace")), s) for s in found)[:sentences]:
        for term in found[sentence]:
            others = OTHERS[term]
            for k in range(min(swaps, len(others))):
                other = others[(mark + k) % len(others)]
                out.append((sentence, WORD.sub(lambda m, a=term, b=other: b if m.group() == a else m.group(), sentence)))
    return out


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        known: dict[str, float] = {}
        weights = self.weights

        def score(text: str) -> float:
            total = self.bias
            if len(known) > CACHE:
                known.clear()
            for w in sorted(words(text)):
                s = known.get(w)
                if s is None:
                    s = known[w] = sum([weights.get(f, 0.0) for f in features(w)])
                total += s
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def fit(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, per_class: int = PER_CLASS, most: int = FEATURES, penalty: float = SWAP) -> Model | None:
    """Learn from about per_class documents of each class, picked by a hash of the identifier. None without both classes.

    known: _key and _label of the documents that may teach, one row a key. The picked labels are bounded by per_class, so
    they go to the texts and no text that isn't picked is shuffled. Of rows that repeat a key the smallest text teaches.
    """
    key, label = F.col("_key"), F.col("_label")
    known = known.where(key.isNotNull() & label.isin(0, 1))
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if len(sizes) < 2:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))])
    few = known.where(F.pmod(F.xxhash64(key.cast("string"), F.lit(10)), F.lit(1_000_000)) < share[label] * 1_000_000)
    picked = docs.join(F.broadcast(few), F.col(f"`{id_col}`") == key).groupBy(key, label).agg(F.min(F.col(f"`{text_col}`")).alias("_text"))

    @F.pandas_udf("f array<int>, n array<int>, near array<long>, s array<struct<f:array<int>,n:array<int>,g:array<int>,m:array<int>>>")
    def vector(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            c = counted(t or "")
            f = np.fromiter(c.keys(), np.int32, len(c))
            near = np.sort(f.astype(np.uint32) * np.uint32(0x9E3779B1))[:2].tolist()
            pairs = [(counted(a), counted(b)) for a, b in swapped(t or "")]
            rows.append((f, np.fromiter(c.values(), np.int32, len(c)), near, [{"f": list(a), "n": list(a.values()), "g": list(b), "m": list(b.values())} for a, b in pairs]))
        return pd.DataFrame(rows, columns=["f", "n", "near", "s"])

    vectors = materialize(picked.select(key.cast("string").alias("k"), label.cast("int").alias("y"), vector(F.col("_text")).alias("v")).select("k", "y", "v.*"), "vectors")
    chosen = _chosen(vectors, most)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf("f binary, n binary, s array<binary>")
    def kept(f: pd.Series, n: pd.Series, s: pd.Series) -> pd.DataFrame:
        column = np.full(1 << SPACE, -1, np.int32)
        column[shared.value] = np.arange(len(shared.value))

        def own(f, n) -> tuple[bytes, bytes]:
            at = column[np.asarray(f, np.int64)]
            order = np.argsort(at[at >= 0])
            return at[at >= 0][order].tobytes(), np.asarray(n, np.int32)[at >= 0][order].tobytes()

        rows = []
        for fs, ns, ss in zip(f, n, s):
            pairs = [own(p["f"], p["n"]) + own(p["g"], p["m"]) for p in ss]
            # Both sides in one value, with their lengths; swaps that change nothing chosen are empty.
            rows.append((*own(fs, ns), [b"".join([np.int32([len(p[0]), len(p[2])]).tobytes(), *p]) if p[:2] != p[2:] else b"" for p in pairs]))
        return pd.DataFrame(rows, columns=["f", "n", "s"])

    rows = vectors.select("k", "y", kept("f", "n", "s").alias("v")).select("k", "y", "v.*").collect()
    rows = sorted(rows, key=lambda r: (len(r.k), r.k))
    y = np.array([r.y for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return None
    return _learn(rows, y, float(sizes[1] / sum(sizes.values())), chosen, penalty)


def _chosen(vectors: DataFrame, most: int) -> np.ndarray:
    """Features that tell the classes apart, by a test of two shares.

    Texts whose two smallest feature hashes agree (copies, and most near copies) count once, else the rare words of one
    copied text look like causes.
    """
    first = vectors.groupBy("near").agg(F.min_by(F.struct("y", "f"), F.struct(F.length("k"), "k")).alias("r")).select("r.y", "r.f")
    first = materialize(first, "first")
    n, n1 = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n1, n0 = max(float(n1), 1.0), max(float(n - n1), 1.0)
    seen = first.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).cast("double").alias("s"), F.sum("y").cast("double").alias("t"))
    a, b, pooled = (F.col("t") + 0.5) / (n1 + 1), (F.col("s") - F.col("t") + 0.5) / (n0 + 1), (F.col("s") + 1) / (n + 2)
    z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    best = seen.where("s >= 3").select("f", F.round(z, 9).alias("z")).where("z > 3").orderBy(F.desc("z"), "f").limit(most)
    return np.array(sorted(r.f for r in best.collect()), np.int64)


def _pairs(rows: list, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences, the same with a term swapped, and the share of all swaps that each distinct pair has."""
    times = Counter(bytes(s) for r in rows for s in r.s)
    total = sum(times.values())
    few = sorted((s for s in times if s), key=crc32)[:PAIRS]
    a, b = np.zeros((len(few), wide), np.float32), np.zeros((len(few), wide), np.float32)
    for k, s in enumerate(few):
        p, q = np.frombuffer(s, np.int32, 2).tolist()
        for out, at, size in ((a, 8, p), (b, 8 + 2 * p, q)):
            out[k, np.frombuffer(s[at : at + size], np.int32)] = np.frombuffer(s[at + size : at + 2 * size], np.int32)
    share = np.array([times[s] for s in few], np.float32)
    # Those beyond PAIRS are stood for by those taken.
    return a, b, share * (sum(n for s, n in times.items() if s) / max(share.sum(), 1) / max(total, 1))


def _learn(rows: list, y: np.ndarray, prior: float, chosen: np.ndarray, penalty: float) -> Model:
    # Each class weighs as in the whole table, so that 0.5 means even odds there.
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for r, out in zip(rows, x):
        out[np.frombuffer(r.f, np.int32)] = np.frombuffer(r.n, np.int32)
    a, b, times = _pairs(rows, len(chosen))
    scale = 1 / np.sqrt(np.maximum((x**2).mean(axis=0), 1e-3))  # rare words move as fast as frequent ones
    x *= scale
    a *= scale
    b *= scale
    share = (weight / weight.sum()).astype(np.float32)
    w, bias = np.zeros(len(chosen), np.float32), float(np.log(prior / (1 - prior)))
    v, vb, t = w.copy(), bias, 1.0
    # The second derivatives of a squared difference of two scores are below 0.45.
    top = 0.25 * float(_largest(x, share)) + L2 + (0.45 * penalty * float(_largest(np.concatenate([a, b]), np.concatenate([times, times]))) if len(a) else 0.0)

    def chance(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(ROUNDS):
        g = share * (chance(x @ v + np.float32(vb)) - y)
        grad, gb = x.T @ g + L2 * v, float(g.sum())
        if len(a):
            p, q = chance(a @ v + np.float32(vb)), chance(b @ v + np.float32(vb))
            change = 2 * penalty * times * (p - q)
            ga, gq = change * p * (1 - p), change * q * (1 - q)
            grad += a.T @ ga - b.T @ gq
            gb += float((ga - gq).sum())
        nw = np.maximum(v - (grad + L1) / top, 0).astype(np.float32)
        nb = vb - gb / top
        if float((v - nw) @ (nw - w)) + (vb - nb) * (nb - bias) > 0:  # momentum points uphill
            t = 1.0
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = (t - 1) / nt
        v, vb = nw + ahead * (nw - w), nb + ahead * (nb - bias)
        w, bias, t = nw, nb, nt
    w = w * scale
    return Model({int(f): float(c) for f, c in zip(chosen, w) if c}, bias)


def _largest(x: np.ndarray, share: np.ndarray) -> float:
    """Largest eigenvalue of the weighted second moments, with the bias column."""
    v, b = np.ones(x.shape[1], np.float32), 1.0
    norm = 1.0
    for _ in range(20):
        r = share * (x @ v + np.float32(b))
        v, b = x.T @ r, float(r.sum())
        norm = float(np.sqrt((v**2).sum() + b * b))
        v, b = v / norm, b / norm
    return norm * 1.05


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """One row for each row of docs: id_col, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Learns from rows outside the held-out fold whose identifier has labels; a null identifier or label teaches
    nothing, of repeated labels the largest counts. Null and empty texts get the score of a text without words;
    without labels of both classes every score is 0. Repeated rows all come back, alike; an empty table gives an
    empty result. Learned weights come from the bounds above PER_CLASS and so on; scores see whole texts.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    known = labels.where(~held_out(id_col, folds, fold)).groupBy(F.col(f"`{id_col}`").alias("_key")).agg(F.max(F.col(f"`{label_col}`")).alias("_label"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(slim, known, id_col, text_col))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer() if shared.value else lambda _: 0.0
        for texts in batches:
            yield pd.Series([score(t or "") for t in texts], dtype="float64")

    found = slim.select(id_col, held_out(id_col, folds, fold).alias("held_out"), F.round(of(F.col(f"`{text_col}`")), 6).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
