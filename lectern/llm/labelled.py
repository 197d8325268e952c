"""Bounded samples of rows to fit classifiers on, and the split that labels may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of doc_id; of rows that repeat a doc_id the smallest, so that it is the same in every run."""
    others = [c for c in rows.columns if c != "doc_id"]
    one = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*([F.min(F.struct(*others)).alias("r")] if others else []), F.count(F.lit(1)).alias("n"))
    return one.select("doc_id", *[f"r.{c}" for c in others]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, whose number is bounded, joined with the texts of docs, one text per doc_id."""
    found = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(rows), F.col("_doc") == F.col("doc_id")).drop("_doc")
    return found.groupBy(*rows.columns).agg(F.min("text").alias("text"))
