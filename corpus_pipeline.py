"""A training corpus in five stages, each over all that the one before it kept.

Quality rules reject documents, line dedup takes shared lines out, of near duplicates one document stays,
documents with benchmark passages go, and the rest is packed into sequences. ``run`` writes each stage as Parquet to
the shared work folder and reads it again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from surfpop.llm.decontaminate import decontaminate
from surfpop.llm.jaccard_join import near_duplicate_stage
from surfpop.llm.line_dedup import line_dedup_stage
from surfpop.llm.packing import pack_documents
from surfpop.llm.quality import quality_stage
from surfpop.session import work_root


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_stage(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark), ("best-fit packing", packing),
]

#: Shingle classes and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_root(spark)}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
