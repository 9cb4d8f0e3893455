"""The corpus pipeline: five stages, each one operator over all that the last one kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage is written as Parquet and read again as the next one's documents.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from rasterloom.llm.common import table, written

#: The mix takes this share of the tokens that are left, each document at most once.
MIX_SHARE, MIX_EPOCHS = (9, 10), 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under its threshold."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, queries.TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical budgets take."""
    mixed = mixing.mix(mixing.with_domain(docs), mixing.WEIGHTS, MIX_SHARE, max_epochs=MIX_EPOCHS, seed=mixing.SEED)
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.encode_documents(docs, queries._vocabulary("word_bpe_49k.json"), added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither compression distances nor Order MinHash: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
