"""Corpus preparation: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, ngram_join, packing, quality, secret_scan
from tidemark.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: five-word shingles, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    beside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")  # columns named as the score's stay as they are
    return quality.score(beside, model).filter(quality.keeps()).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that repeat benchmark items."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redacted(docs, secret_scan.fit(secret_scan.labelled_findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, by piece, with each piece's place in the training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("n-gram jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", masked),
    ("packing", packed),
]

#: The stages' classifiers and tokenizer can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
