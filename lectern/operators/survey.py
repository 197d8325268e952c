"""Ontology discovery: what the corpus itself declares, proposed as types and properties for a person to accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import data_type, property_id
from lectern.operators.bundle import RESERVED
from lectern.operators.graph import kept
from lectern.operators.text import align_quotes, header_fields

#: Header fields that one task counts.
PER_TASK = 500_000


def sampled(documents: DataFrame, n: int) -> DataFrame:
    """The oldest documents, by added then document_id."""
    return documents.orderBy("added", "document_id").limit(n)


def told_fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """Header fields with their property_id, dealt out by document: the more there are, the more tasks, as each holds the ids that it counts."""
    fields = kept(header_fields(documents, text).withColumn("property_id", property_id(F.col("key"))))  # counted, then read
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fields.count() // PER_TASK))
    return fields.repartition(tasks, "document_id")


def supported(fields: DataFrame) -> DataFrame:
    """(property_id, support, data_type) of ``told_fields``: how many documents have each property."""
    return fields.groupBy("property_id").agg(F.count_distinct("document_id").alias("support"), data_type(F.col("value")).alias("data_type"))


def header_survey(documents: DataFrame, text: str = "text", least: int = 2, quotes: int = 3) -> DataFrame:
    """(property_id, support, data_type, quotes, accepted): header fields by how many documents have them, with a few lines that show them; those below the least are reported, not proposed."""
    fields = told_fields(documents, text).where(~F.col("property_id").isin([n for n, _ in RESERVED]))
    order = Window.partitionBy("property_id").orderBy("document_id", "line")
    shown = fields.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= quotes)
    lines = shown.groupBy("property_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat_ws(": ", "key", "value").alias("q")))), lambda x: x["q"]), "|").alias("quotes"))
    return supported(fields).join(lines, "property_id").withColumn("accepted", F.col("support") >= least)


def corroborated(proposals: DataFrame, documents: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """proposals (type_id, property_id, document_id, quote) of a model by the documents where a quotation really stands: (type_id, property_id, support).

    Quotations are looked for in the document that they were made of; what was only found by its
    first words counts for nothing. Header fields widen a property's support, and a type has as
    much as its properties at least.
    """
    held = proposals.join(documents.select("document_id", "text"), "document_id")
    keyed = held.select(F.struct("document_id", "type_id", "property_id").alias("document_id"), "text", F.col("quote").alias("span"))
    found = align_quotes(keyed).where("status IS NOT NULL AND status <> 'match_fuzzy'").select("document_id.*").distinct()
    if headers is not None:
        named = proposals.select("type_id", "property_id").distinct()
        found = found.unionByName(headers.select("document_id", property_id(F.col("key")).alias("property_id")).join(named, "property_id").select("document_id", "type_id", "property_id")).distinct()
    own = found.where("property_id IS NOT NULL").groupBy("type_id", "property_id").agg(F.count_distinct("document_id").alias("support"))
    types = found.groupBy("type_id").agg(F.count_distinct("document_id").alias("support")).withColumn("property_id", F.lit(None).cast("string"))
    return own.unionByName(types.select("type_id", "property_id", "support"))


def upserted(known: DataFrame, found: DataFrame, survey_id: str) -> DataFrame:
    """Candidates (candidate_id, kind, type_id, property_id, n_documents, status, survey_id): found ones take their place with the new count, decisions stay."""
    keys = ["kind", "type_id", "property_id"]
    named = found.withColumn("candidate_id", F.concat_ws(":", *keys))
    out = known.select("candidate_id", F.col("status").alias("held"), F.col("n_documents").alias("before"), F.col("survey_id").alias("earlier"), *[F.col(k).alias(f"_{k}") for k in keys]).join(named, "candidate_id", "full")
    return out.select("candidate_id", *[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.coalesce("n_documents", "before").alias("n_documents"), F.coalesce("held", F.lit("proposed")).alias("status"), F.when(F.col("n_documents").isNotNull(), F.lit(survey_id)).otherwise(F.col("earlier")).alias("survey_id"))


def candidates(known: DataFrame, status: str | None = None, limit: int = 25) -> DataFrame:
    """The first candidates, those of most documents first, each with the number of all."""
    own = known.where(F.col("status") == status) if status else known
    total = own.agg(F.count(F.lit(1)).alias("n_total"))
    return own.orderBy(F.desc("n_documents"), "kind", "type_id", "property_id").limit(limit).crossJoin(F.broadcast(total))  # one row
