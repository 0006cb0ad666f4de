"""Documents to training tokens, in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_dir, table
from tessera.llm.mixing import repeat_to_targets
from tessera.llm.secrets import redact_secrets
from tessera.llm.sentencepiece_codec import digests
from tessera.llm.simhash import keep_one_of_each
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; all documents stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until their domains' tokens meet the target weights; none goes."""
    return repeat_to_targets(docs, table(spark, sf_dir, "labels"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return digests(docs)


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_duplicates), ("secret scans", secret_scans), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Classifiers, connected components and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
