"""The training-data pipeline over documents: five stages, each by one operator.

language: documents whose language is not recognised go. near: one document of
each near-duplicate group stays. repeats: passages of 200 bytes that occur twice
are cut. secrets: secrets are replaced by a mark. packing: the rest becomes
sequences of 2048 tokens.

Defined results: a null text or one without a letter is of no language and goes;
repeated rows count once from the second stage on; rows of equal texts and
different ids are one group; a text that is cut to nothing stays, empty, and packs
to its end id; columns beside doc_id, text and lang pass through, n_chars is set
anew where it exists; an empty table gives empty stages, and a table without a
learnable language keeps all its documents in the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language_id, near_dedup, packing, secret_scan, suffix_dedup
from tidewell.llm.common import documents, shared_dir
from tidewell.llm.tokenise import public_file


def counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of changed texts with their number of characters set anew, where docs have that column."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return language_id.accepted(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    return counted(suffix_dedup.remove(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mark."""
    return counted(secret_scan.redact(docs, secret_scan.train(secret_scan.default_samples(spark))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, public_file("word_bpe_49k.json"))


STAGES = [("language", language), ("near", near), ("repeats", repeats), ("secrets", secrets), ("packing", pack)]

#: Models, minimum hashes and a tokenizer file have no SQL form; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex[:12]}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
