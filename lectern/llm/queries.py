"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, licenses, line_dedup, packing, quality_gam, quality_rules, secrets, simhash, spelling, substring_dedup, suffix_dedup, toxicity, upsert


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_documents(function: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": over_documents(secrets.report),
        "op2_license_scan": over_documents(licenses.report),
        "op3_suffix_array_dedup": over_documents(suffix_dedup.report),
        "op4_quality_classifier": lambda spark, d: quality_gam.scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_quality_rules": over_documents(quality_rules.report),
        "op6_line_dedup": over_documents(line_dedup.report),
        "op7_best_fit_packing": over_documents(packing.packed),
        "op8_toxicity": lambda spark, d: toxicity.scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_simhash_near_dedup": over_documents(simhash.report),
        "op10_decontamination": lambda spark, d: decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op11_keyed_upsert": lambda spark, d: upsert.report(table(spark, d, "clients"), table(spark, d, "client_changes")),
        "op12_substring_dedup": over_documents(substring_dedup.report),
        "op13_spelling_variants": over_documents(spelling.groups),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op6_line_dedup": line_dedup.ORACLE, "op10_decontamination": decontaminate.ORACLE}
