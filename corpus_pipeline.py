"""A training-data pipeline: five operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; run() writes it as Parquet and reads it back for the next stage, and then drops the
table before. All stages but the last return the columns of their input, whatever further ones it
has; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from sparkloom.llm import decontam, quality, secrets, sentpiece, similar
from sparkloom.llm.common import drop_path, written
from sparkloom.llm.queries import PIECE_BPE, trusted_ids


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Trusted are those labelled good and not toxic. Null and empty texts stay; repeated rows share a
    verdict, as it depends on text and language alone; a null language is one of its own; without
    any trusted text all rows stay. Ties with the threshold stay.
    """
    return quality.keep_good(docs, trusted_ids(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null, empty and blank texts are copies of each other. A null id stays only where its group has no
    other; different texts under one id, or without one, are documents of their own; of rows with
    equal id and words one stays.
    """
    return similar.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts, and texts without words, stay; repeated rows are decided each for itself,
    alike; an empty benchmark leaves all rows.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; all rows stay.

    Null texts stay null, texts without a finding as they are; stretches that overlap become one mark.
    """
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, how many there are, their crc32, and whether they decode to the text.

    Null and empty texts have no pieces; repeated rows are encoded each for itself.
    """
    return sentpiece.with_pieces(docs, public_tokenizers.path(PIECE_BPE))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: SQL expresses none of the first, second and last stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return docs
