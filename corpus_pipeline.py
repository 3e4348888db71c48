"""A corpus pipeline over ``documents``: five stages, each one of the library's training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, language_id, near_copies, secret_scan, sentencepiece_codec
from siftlake.llm.common import held_out, session, stored
from siftlake.llm.queries import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others get the identified language."""
    session(spark)
    found = language_id.identified(docs, language_id.fit(docs, usable=~held_out()))
    return found.where(~F.col("rejected")).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id. Jaccard similarity 0.8 of five-word shingles.

    A row without an id names no document to drop and stays.
    """
    session(spark)
    groups = near_copies.near_copies(docs, size=5, similarity=0.8)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(stored(copies, "copies").hint("merge"), "doc_id", "left_anti")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    session(spark)
    masked = secret_scan.redacted(docs, secret_scan.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding."""
    session(spark)
    vocabulary = sentencepiece_codec.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode(docs, vocabulary)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]
#: The stages cannot be put in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result but the last stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
