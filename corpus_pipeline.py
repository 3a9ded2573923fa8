"""From raw documents to sampled token ids: the stages of a training corpus, each over all that the one before kept.

Every stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables, and keeps extra
columns. Null and empty texts are scored like others, are copies of one another, and leave at the mixing of sources, since they
have no words. Rows without an id stay until the end unless they are exact copies of others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import exact_dedup, mixing, near_dedup, piece_sampling, quality
from gristmill.llm.shared import fresh_dir


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_distinct(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    return near_dedup.keep_one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources serves, repeats included, in its order."""
    return mixing.mixed_documents(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return piece_sampling.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), samples=2)


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("piece sampling", sample_pieces),
]

#: A trained classifier and noise from hashes are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
