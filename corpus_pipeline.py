"""From raw documents to token ids: rejects, near copies, benchmark passages and secrets go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barspark.llm import contamination, jaccard, pieces, quality, secrets
from barspark.llm.common import fresh, shared_path, table
from barspark.llm.queries import quality_model, tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labelled ones, doesn't reject."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 and more."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return contamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew where one was found."""
    (whole,) = fresh(docs, "whole")
    found = secrets.scan(docs.select("text", F.struct("*").alias(whole)), secrets.train(docs))
    marked = F.col(whole).withField("text", secrets.redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        marked = marked.withField("n_chars", F.when(F.col("spans") == "", F.col(whole)["n_chars"]).otherwise(F.length(marked["text"]).cast("long")))
    return found.select(marked.alias(whole)).select(f"{whole}.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, and whether these give the text again."""
    return pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality", good), ("near_copies", distinct), ("benchmark", clean), ("secrets", without_secrets), ("pieces", encoded)]

#: The stages of fitted rules, Markov models and merges cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
