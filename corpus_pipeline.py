"""The corpus pipeline: quality filter, exact and near de-duplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and reads all that its predecessor kept; run() writes and rereads the
result of each. A stage drops what its operator decides: the classifier its rejects, exact dedup all but the
largest id of equal texts, the Jaccard join all but the smallest id of a component; the mix repeats or leaves
out documents as the schedule takes them. The last stage gives the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunemill.llm import bpe, exact_dedup, jaccard, mixing, quality
from tunemill.llm.queries import tokenizer_ranks
from tunemill.session import spread, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_ranks())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("source mix", mix),
    ("BPE encoding", encode),
]

#: The classifier's scores have no SQL form; tests/llm hold the stages and run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
