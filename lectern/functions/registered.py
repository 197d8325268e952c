"""The text functions under names of their own in SQL, for bundles and people who write queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalar


def register(spark: SparkSession) -> list[str]:
    """Register the functions with a session; their names.

    name_key(name, style), snap_confidence(x) and property_id(key) are SQL
    expressions that the optimizer sees through; align(text, quote) is Arrow-batched;
    find_values(text) is a table function of dates and amounts.
    """
    from lectern.operators.text import align, find_amounts, find_dates

    levels = " ".join(f"WHEN x >= {level} - 1e-9D THEN {level}D" for _, level in scalar.RUBRIC[:-1])
    plain = r"regexp_replace(btrim(regexp_replace(regexp_replace(lower(x), '(?U)[^\\w\\s]', ' '), '(?U)\\s+', ' ')), '^the ', '')"
    forms, titles = "|".join(scalar.LEGAL_FORMS), "|".join(scalar.HONORIFICS)
    short = f"if(s = 'personal', regexp_replace({plain}, '^(?:(?:{titles}) )+', ''), regexp_replace({plain}, '(?: (?:{forms}))+$', ''))"
    made = {
        "snap_confidence(x DOUBLE) RETURNS DOUBLE": f"CASE WHEN x IS NULL OR isnan(x) THEN 0.5D {levels} ELSE {scalar.RUBRIC[-1][1]}D END",
        "name_key(x STRING, s STRING) RETURNS STRING": f"coalesce(nullif(btrim({short}), ''), {plain})",
        "property_id(x STRING) RETURNS STRING": "coalesce(nullif(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_'), '^_+|_+$', ''), ''), 'field')",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("struct<start int, end int, status string>")
    def aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, quotes in batches:
            found = [align(t or "", q or "") for t, q in zip(texts, quotes, strict=True)]
            yield pd.DataFrame({"start": pd.array([f[0] for f in found], dtype="Int32"), "end": pd.array([f[1] for f in found], dtype="Int32"), "status": [f[2] for f in found]})

    @F.udtf(returnType="kind: string, raw: string, value: string, currency: string, position: int, confidence: double, role: string")
    class FindValues:
        def eval(self, text: str):
            for f in find_dates(text or "") + find_amounts(text or ""):
                yield f["kind"], f["raw"], f["value"], f["currency"], f["position"], f["confidence"], f["role"]

    spark.udf.register("align", aligned)
    spark.udtf.register("find_values", FindValues)
    return sorted([*(head.partition("(")[0] for head in made), "align", "find_values"])


def from_json_or(text, kind: str, fallback):
    """JSON as a value of a type; the fallback for null, empty and broken text."""
    return F.coalesce(F.from_json(F.nullif(F.btrim(text), F.lit("")), kind, {"mode": "PERMISSIVE"}), fallback)


def required(column, allowed: list[str] | None = None, name: str = "value"):
    """column, or an error where it is blank or none of the allowed words."""
    bad = F.coalesce(F.btrim(column), F.lit("")) == ""
    if allowed is not None:
        bad = bad | ~F.coalesce(column, F.lit("")).isin(allowed)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} may not be "), F.coalesce(column, F.lit("null"))))).otherwise(column)
