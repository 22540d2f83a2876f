"""Documents from raw to shards: each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rolegraph.llm import classifier, decontamination, jaccard_join, mixing, sharding
from rolegraph.llm._rows import drop_folder, shared_folder
from rolegraph.llm.queries import WEIGHTS, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose probability of the best grade is under one half go."""
    return classifier.select_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels"), classifier.grade_of()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component of linked documents the one of smallest id stays."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: contaminated documents go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents stay; their order, in files and rows, is the mixture that the next stage numbers."""
    return mixing.mixed(docs, WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: whole documents with their shard and slot; row numbers follow the mixture's files."""
    return sharding.placed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifier's fit is out of SQL's reach; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet in the shared folder and read again, and goes when its
    successor is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
