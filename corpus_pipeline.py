"""The corpus pipeline: ``run(spark, sf_dir)`` takes ``documents`` through the stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again for the next.  All but the last return the columns of
``documents``.  Edge cases are those of the operators; a document that loses
all its lines stays with an empty text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from presswork.llm.common import landed, short_batches
from presswork.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    short_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose fingerprints of three-word shingles link at three bits or fewer."""
    short_batches(spark)
    return simhash.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: The toxicity stage's trained model and the packing stage's tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
