"""From raw documents to a tokenised training mix; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bpe, exact_dedup, mixing, simhash_dedup, toxicity
from wardline.llm.common import Shelf, fold_of, table
from wardline.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of near fingerprints connect the one with the smallest doc_id."""
    return simhash_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to twice."""
    return mixing.mixture(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests; one row for each time that the mix takes a document."""
    return bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]

#: A learned score, 64-bit fingerprints, random rounding and merges can't be told in SQL; a test has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shelf = Shelf(spark, "pipeline")
    for name, stage in STAGES:
        docs = shelf.keep(stage(spark, docs, sf_dir), name)
    return docs
