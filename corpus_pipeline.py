"""A training corpus in four stages: toxic documents go, documents of low quality go, one
document of each SimHash group stays, and what is left is packed, each sequence with its
token ids.

Every stage is written as Parquet to the shared folder and read again by the next one, so
its decisions hold for all that follows and no stage is computed twice. The models are
learned from the labels of the documents that a stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import byte_cnn, packing, simhash, toxicity
from tapeline.llm.queries import TOKENIZER
from tapeline.llm.shared import fresh
from tapeline.llm.tables import importable, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fitted = toxicity.model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, fitted, carry=True)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fitted = byte_cnn.model(docs, read(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, fitted, carry=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("simhash", one_of_each_group),
    ("packing", packed),
]

# Models and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
