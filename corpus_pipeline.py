"""A training corpus in five stages: toxicity, exact and near duplicates, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, mixing, pieces, simhash, toxicity
from quarry.llm.common import shared_folder, table
from quarry.llm.queries import model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that their nearest labelled examples call toxic."""
    index = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return toxicity.drop_toxic(docs, index)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of linked SimHash fingerprints."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, by their target weights."""
    return mixing.mixed(docs, mixing.Mixture(repetition=2.0, cover=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text, a row for each reading of a document."""
    return pieces.encode_pieces(docs, model_path())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix), ("pieces", encode)]

#: Neither nearest neighbours nor hashes, tries and tokenizers can be said in SQL; tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again."""
    base = f"{shared_folder(spark, 'quarry-pipeline-')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
    return docs
