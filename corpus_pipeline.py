"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, neardup, packing, pii, toxicity
from factloom.llm.queries import fit_toxicity
from factloom.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go. The model learns from the labels of the table ``documents``."""
    fitted = fit_toxicity(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return toxicity.keep_clean(docs.select(*COLUMNS), fitted)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return neardup.keep_one(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars counts the new text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order that keeps every source on its weight; files and their rows follow that order."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2,048, which follow the order of files and rows: neighbours share sequences, and sequence ids rise with it.

    ``docs`` must be read from files, as the stage before wrote them. A worker keeps few words, as the executor still holds the memory of the stages before.
    """
    placed = docs.withColumn("place", mixing.file_order())
    return packing.pack_documents(placed, public_tokenizers.path("byte_bpe_50k.json"), place_col="place", keep=50_000)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data),
          ("mixing", mix_sources), ("packing", pack_sequences)]
#: Language models, signatures and packings have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
