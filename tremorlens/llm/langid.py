"""Operator 6: language ID with string kernels.

Kernel: blended spectrum with presence, k(x, y) = n-grams (1 to 3 code points) that both have, over the root of
the product of their numbers. Landmark documents give a Nyström approximation, one-versus-rest kernel ridge
regression is solved on it, and as the kernel is linear in the presence vector of a document, the landmarks and
the dual weights fold into one matrix: a batch of documents is scored by one matrix product. n-grams that no landmark has are left
out of the norm of a scored document, which changes its score but not its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: n-grams are told apart by 20 bits of a hash.
SPACE = 20
NGRAMS = 3
#: Bounds of the fit: about so many documents a language, landmarks in all, and languages (the most frequent).
PER_LANGUAGE, LANDMARKS, LANGUAGES = 300, 256, 500
RIDGE = 1e-3
#: Documents scored in one product, and code points taken at a time.
BATCH, CHARS = 64, 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the rolling hash, one for each place of an n-gram.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hashed n-gram) for every place, with repeats, over pieces that overlap where a long text is cut."""
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low) - NGRAMS + 1, 1), CHARS):
            held.append((k, low[at : at + CHARS + NGRAMS - 1]))
            size += len(held[-1][1])
            if size >= CHARS:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) for _, t in held])
    piece = np.repeat(np.arange(len(held)), lengths)
    doc = np.repeat(np.array([k for k, _ in held]), lengths)
    mixed, docs, hashes = np.zeros(len(chars), np.uint64), [], []
    for n in range(1, NGRAMS + 1):
        stop = len(chars) - n + 1
        if stop <= 0:
            break
        mixed = mixed[:stop] + chars[n - 1 :] * np.uint64(MIX[n - 1])
        whole = piece[:stop] == piece[n - 1 :]
        h = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX[3]) + np.uint64(n * MIX[0] & (1 << 64) - 1)
        hashes.append((h >> np.uint64(64 - SPACE))[whole].astype(np.int64))
        docs.append(doc[:stop][whole])
    return np.concatenate(docs) if docs else doc, np.concatenate(hashes) if hashes else doc


def presence(text: str) -> np.ndarray:
    """Sorted distinct n-gram hashes of a whole text."""
    seen = np.zeros(1 << SPACE, bool)
    for _, h in grams([text]):
        seen[h] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # hash -> row of weights, -1 for n-grams that no landmark has
    weights: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), BATCH):
            some = texts[at : at + BATCH]
            x = np.zeros((len(some), len(self.weights)), np.float32)
            for doc, h in grams(some):
                slot = self.slots[h]
                hit = slot >= 0
                x[doc[hit], slot[hit]] = 1
            margins = x @ self.weights / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            chances = np.clip((margins + 1) / 2, 0, 1)
            chances /= np.maximum(chances.sum(axis=1, keepdims=True), 1)
            best = margins.argmax(axis=1)
            for text, k, p in zip(some, best.tolist(), chances):
                out.append((self.languages[k], round(float(p[k]), 6)) if LETTER.search(text) else (UNKNOWN, 0.0))
        return out


def _kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Between documents given by their sorted hashes."""
    seen = np.zeros(1 << SPACE, np.float32)
    out = np.zeros((len(a), len(b)))
    flat, stops = np.concatenate(b), np.cumsum([0, *map(len, b)])[:-1]
    root_b = np.sqrt([len(x) for x in b])
    for k, x in enumerate(a):
        seen[x] = 1
        out[k] = np.add.reduceat(seen[flat], stops) / (np.sqrt(len(x)) * root_b)
        seen[x] = 0
    return out


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from about per_language documents of each of the LANGUAGES most frequent languages, picked by a hash of the
    identifier. Rows that repeat identifier and language teach once, by their smallest text.

    Only the hashed n-grams of these come to the driver, which is at most
    languages * per_language * 2**20 numbers and in practice a few thousand a document. None without rows.
    """
    lang, key = F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    train = train.where(lang.isNotNull() & key.isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in train.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES).collect()}
    if not sizes:
        return None

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([presence(t).tobytes() for t in texts])

    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    picked = train.where(F.pmod(F.xxhash64(key.cast("string"), F.lit(6)), F.lit(1_000_000)) < share[lang] * 1_000_000)
    picked = picked.groupBy(key.cast("string").alias("k"), lang.alias("lang")).agg(F.min(F.col(f"`{text_col}`")).alias("t"))
    rows = picked.select("k", "lang", hashed("t").alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r.lang, len(r.k), r.k))
    languages = sorted({r.lang for r in rows})
    docs = [np.frombuffer(r.h, np.int32) for r in rows]
    y = np.array([[1.0 if r.lang == lang else -1.0 for lang in languages] for r in rows])
    each = max(8, landmarks // len(languages))
    marks = [d for lang in languages for d in [d for d, r in zip(docs, rows) if r.lang == lang][:each]]
    knm, kmm = _kernel(docs, marks), _kernel(marks, marks)
    # Each language weighs the same, whatever its number of documents.
    weight = np.array([1 / sum(r.lang == lang for r in rows) for lang in [r.lang for r in rows]])[:, None]
    weight *= len(rows) / weight.sum()
    ridge = RIDGE * len(rows)
    dual = np.linalg.solve(knm.T @ (weight * knm) + ridge * kmm + 1e-8 * np.eye(len(marks)), knm.T @ (weight * y))
    vocabulary = np.unique(np.concatenate(marks))
    slots = np.full(1 << SPACE, -1, np.int32)
    slots[vocabulary] = np.arange(len(vocabulary))
    weights = np.zeros((len(vocabulary), len(languages)))
    for d, row in zip(marks, dual):
        weights[slots[d]] += row / np.sqrt(len(d))
    return Model(languages, slots, weights.astype(np.float32))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "lang_id") -> DataFrame:
    """docs with struct column `name` (lang_pred, score). Null texts and texts without a letter, and all texts
    where nothing could be learned, are `und` with score 0. A column of that name is replaced, so callers choose one that docs lacks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        found = known.predict([t or "" for t in texts]) if known else [(UNKNOWN, 0.0)] * len(texts)
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(name, of(F.col(f"`{text_col}`")))


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the identifier as text leaves `fold`; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row for each input row: id_col, held_out, lang_pred, score (0 to 1), learned outside the held-out fold.

    Rows with a null identifier or language teach nothing but are predicted. Repeated rows all come back, alike; an
    empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col), F.col(f"`{lang_col}`").alias(lang_col))
    model = fit(slim.where(~held_out(id_col, folds, fold)), id_col, text_col, lang_col)
    found = identify(slim.drop(lang_col), model, text_col)
    return found.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "lang_id.lang_pred", "lang_id.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
