"""From raw documents to token ids: each stage is one operator of ``lectern.llm``, over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

For every stage: a null text counts as empty; rows with a null id, language or source are judged like any other; very
long texts are read whole; rows that repeat are judged alike, each on its own, but near_copies keeps one of them; an
empty table gives an empty result; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, fertility, mixing, nearcopies, toxicity
from lectern.llm.common import crc_fold, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the fertility bands of their language."""
    return fertility.judged(docs).filter("kept").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a network that learns from the labels outside the held-out fold."""
    weights = toxicity.fitted(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)
    return toxicity.scored(docs, weights).filter("predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return nearcopies.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the entropy-balanced mix of sources says."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    return bpe.digests(docs, keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix),
    ("bpe", tokens),
]

#: SQL can't express the network, the merges or the draws; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
