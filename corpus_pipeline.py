"""A training corpus from raw documents: toxic documents go, near copies are
reduced to one, repeated passages are cut, sources are mixed to their target
weights and the result is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from precis.llm import mixing, near, packing, passages, toxicity
from precis.llm.common import load, materialize

#: MinHash links, sampled labels and token ids have no SQL form
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit_on_folds(docs, load(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near.drop_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return passages.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean),
    ("near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("mix", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
