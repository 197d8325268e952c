"""A corpus pipeline of five operators over ``documents``; each stage is written as Parquet and read again by the next.

quality rules -> line dedup -> SimHash near-dedup -> benchmark decontamination -> best-fit packing

Rejected documents go, repeated lines go (n_chars follows the text), one document of each
near-duplicate group stays, documents that contain a benchmark item go, and what is left is
packed: the last stage returns one row per piece. All others return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from lectern.llm.common import finished, remove, written_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has neither the quantile sketches, the fingerprints nor the tokenizer; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = finished(partial(stage, spark, docs, sf_dir), f"stage-{i}")  # what the stage wrote for itself goes
        remove(spark, [path] if path else [])
        path = written_path(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
