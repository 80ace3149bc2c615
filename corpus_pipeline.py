"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing; each stage on all its predecessor kept.

Rows are told apart by their place in the input, so rows of null or equal doc_id are documents like any other. All stages but the
last keep all columns, whatever their names. Empty documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import quality_classifier
from factloom.llm.common import documents, stored
from factloom.llm.exact_dedup import survivors
from factloom.llm.minhash import survivors as near_survivors
from factloom.llm.mixing import emitted
from factloom.llm.packing import pack, pieces
from factloom.llm.queries import gpt_encoder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of 1 or more is at least one half; the grades come from `labels`."""
    rated = quality_classifier.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.select(docs, quality_classifier.train(docs, rated))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return survivors(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles, the one with the smallest doc_id."""
    return near_survivors(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents it emits twice are two rows, those it doesn't emit go."""
    return emitted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(pieces(docs, gpt_encoder()))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("source mixing", mixed), ("best-fit packing", packed)]

#: The classifier, the near-duplicate components and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
