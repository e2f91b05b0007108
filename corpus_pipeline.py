"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE; each stage is written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlens.llm import bpe, exact_dedup, langid, mixing, simhash
from tremorlens.llm.common import documents, findable, free_name, materialize

#: Least score of a predicted language. Only texts without letters score lower in practice.
LEAST_SCORE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language isn't recognised."""
    findable(spark)
    model = langid.fit(docs, "doc_id", "text", "lang")
    name = free_name(docs, "lang_id")
    found = langid.identify(docs, model, name=name)
    return found.where((F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest identifier of each group of equal texts."""
    return exact_dedup.exact_dedup(docs, keep="largest", carry=True).where("kept").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies; fingerprints propose pairs, shared five-word shingles decide."""
    findable(spark)
    return simhash.keep_one(docs).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents by their place in the mixture; files and rows are written in that order."""
    mixed = mixing.mix(docs, carry=True)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    findable(spark)
    return bpe.encode_digests(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Language ID, fingerprints and BPE are not expressible in SQL; the tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
