"""The corpus pipeline: documents without toxic ones and near-duplicates, mixed to target weights and encoded.

Each stage takes the rows that its predecessor kept, with the columns of documents; the last one returns token digests. The tables beside documents
come from sf_dir. The near-duplicate stage works on five-word shingles at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, minhash_dedup, mixing, toxicity
from tidemark.llm.common import staged, table
from tidemark.llm.token_count import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't call toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or sampled until the sources have their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    return bpe_codec.encoded(docs, vocabulary_path(bpe_codec.VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("source_mixing", mix_sources), ("bpe_encoding", encode)]
#: SQL can express neither the classifier nor the encoder; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = staged(docs, name)
    return docs
