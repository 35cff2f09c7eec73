"""The corpus pipeline: five operators, each working on what the one before it kept.

Toxic documents go; one document of each group of near copies stays; documents that hold
benchmark passages go; secrets are blacked out; what is left is packed for training.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, ngram_join, packing, secrets, toxicity
from gridloom.llm.queries import table, tokenizer
from gridloom.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model).where("score < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by id) of each group of near copies."""
    return ngram_join.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text."""
    usual = secrets.usage(docs)
    forest = secrets.train(secrets.labelled_findings(docs, usual))
    return secrets.redact(docs, usual, forest)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# Trained models and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    The folder lies beside the session's checkpoints, where every executor can read it.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
