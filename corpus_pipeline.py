"""A training corpus from raw documents: good, distinct, clean of benchmarks, mixed to weights, sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import materialize, table
from panelforge.llm.decontamination import clean_documents
from panelforge.llm.mixing import mixed_documents
from panelforge.llm.ngram_join import distinct_documents
from panelforge.llm.quality import good_documents
from panelforge.llm.sharding import shard_documents, with_law

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_law(shard_documents(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("n-gram Jaccard join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained model decides what stays, which SQL cannot express; ``tests/llm`` hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
