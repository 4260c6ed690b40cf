"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on.

All stages but the last return the columns of ``docs``, whatever their names and types; ids may be whole numbers or texts; an empty table stays
empty. What each does with nulls, empty and long texts, ties and repeated rows is said below; texts are always taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from eventloom.llm.registry import MIX_WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected toxicity severity reaches the threshold go.

    Null and empty texts have no toxic word and stay; repeated rows stay or go together; null ids are scored like others. Labels with a null or of no
    document aren't trained on; without toxic or without clean labelled rows all documents stay.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays.

    A null text is equal to none and stays; empty texts are equal to each other; a null id is larger than any; of rows that repeat text and id one stays.
    """
    return exact_dedup.dedup_batches(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Null ids and texts without words are in no group and stay; rows that repeat an id are one document and stay or go together.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources reach their target weights.

    A null source is a source of its own; one without tokens is not emitted; null and empty texts go at the rate of their source; a null id draws by its
    text, and repeated rows draw alike.
    """
    return mixing.mix(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``tokens``, their number ``n_tokens`` and ``exact`` (whether decoding gives the text back) take the place of the text.

    A null text has nulls there, an empty one no tokens; each row is encoded by itself. A new column whose name is taken gets an underscore.
    """
    return bpe.encode_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The regression, the near duplicates and the tokens can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
