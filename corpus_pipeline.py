"""A training corpus from ``documents``: language, near copies, personal data, mixture, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import language, mixing, nearcopies, packing, personal
from ledgerloom.llm.staging import own_folder, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the learned stages and the tokenizer; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a finished stage has read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_folder(spark) as keep_only:
        for name, function in STAGES:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
            if docs.inputFiles():
                keep_only(docs)
    return docs
