"""From raw documents to token ids: quality rules, near duplicates, secrets, mixing, encoding.

Each stage is written as Parquet into the shared folder and read again by the next, so a lost executor costs a task, not a stage.
What a stage writes on its way is removed once its result is written, and that result once the next stage's is: two stages' tables are there at a time.
All stages but the last keep the columns of documents, whatever they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feltloom.llm import mixing, near_dup, pieces, quality, secrets
from feltloom.llm.common import drop, passing_tables, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule; a null or empty text does not."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8): the one with the least doc_id, once."""
    return near_dup.keep_one(docs, near_dup.Params(words=5, percent=80))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; n_chars follows."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token-prefix of its seeded epoch, up to its share of nine tenths of all tokens; no document twice."""
    return mixing.mixed(docs, mixing.Params(max_epochs=1))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    import public_tokenizers

    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("token ids", token_ids),
]

#: Sketches, redaction and encoding are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing_tables(spark) as shared:
            path = f"{shared}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            docs = written(stage(spark, docs, sf_dir), name, path=path)
        if before:
            drop(spark, before)
        before = path
    return docs
