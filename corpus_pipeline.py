"""A corpus pipeline of five operators: quality, near-duplicates, secrets, the mix of sources, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import dedup, mixing, pieces, quality, secrets
from gleanery.llm.queries import model_bytes
from gleanery.session import cut, owning, remove_unread

#: Working tables of the last stage; its result may still read them.
_working: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose working tables go when the next one starts, as its result is written by then. Tables that the next
    stage's documents still read stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_unread(spark, _working, docs)
        with owning(_working):
            return work(spark, docs, sf_dir)

    return run_stage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return dedup.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.mask_secrets(docs, secrets.fit_field(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return pieces.encode_documents(docs, model_bytes(), keys=("doc_id", "source"))


STAGES = [(name, stage(work)) for name, work in (
    ("quality", good), ("near_dedup", distinct), ("secrets", without_secrets), ("mixing", mixed), ("encoding", encoded))]

#: Robust outliers, the cube method and transducers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES[:-1]:
        docs = cut(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
