"""A training corpus from raw documents: reject bad texts, drop exact and near copies, mix sources, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import exact_dedup, mixing, near_dedup, packing, quality
from weft.llm.common import new_dir, staged
from weft.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near_dedup.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences, in little memory, as the executors hold that of the stages before too."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), small=True)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier is trained and shingle hashes, permutations and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    An empty table gives no rows. Null texts are empty and equal to empty ones; rows without an id are documents of their own.
    Of repeated rows one stays. Without usable labels nothing is rejected. Further columns, whatever their names, are kept up
    to the last stage, which returns pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"{base}/{i}")
    return docs
