"""Questions that the graph and the pages raise, ranked and with the judgements that people made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalar import fingerprint
from lectern.operators import graph
from lectern.operators.review import judged

#: The order of states, those first that a person looked at and left standing.
STATES = ["standing", "open", "explained", "dismissed"]


def question(rows: DataFrame, kind: str, entities, summary, documents, confirmed) -> DataFrame:
    """(kind, fingerprint, digest, summary, entities, n_documents, confirmed): a question is known by its kind and pages, its evidence by its documents."""
    own = F.array_sort(entities)
    return rows.select(F.lit(kind).alias("kind"), fingerprint(F.lit(kind), own).alias("fingerprint"), fingerprint(F.array_sort(documents)).alias("digest"), summary.alias("summary"), F.array_join(own, ",").alias("entities"), F.size(F.array_distinct(documents)).cast("long").alias("n_documents"), confirmed.alias("confirmed"))


def two_parts(roles: DataFrame) -> DataFrame:
    """Pages with several parts in one document. roles: document_id, entity_id, part, status."""
    rows = roles.groupBy("document_id", "entity_id").agg(F.array_sort(F.collect_set("part")).alias("parts"), F.bool_and(F.col("status").isin("confirmed", "amended")).alias("ok")).where("size(parts) > 1")
    return question(rows, "two_parts_in_one_document", F.array("entity_id", F.col("document_id")), F.concat(F.col("entity_id"), F.lit(" is "), F.array_join("parts", " and "), F.lit(" of "), F.col("document_id")), F.array("document_id"), F.col("ok"))


def shared_detail(details: DataFrame, most_named: int = 3) -> DataFrame:
    """Pages of a type that state one detail. details: type_id, property_id, value, entity_id, document_id, status."""
    told = details.withColumn("value", F.lower(F.btrim("value"))).where("value <> ''")
    rows = told.groupBy("type_id", "property_id", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("pages"), F.array_sort(F.collect_set("document_id")).alias("docs"), F.bool_and(F.col("status").isin("confirmed", "amended")).alias("ok")).where("size(pages) > 1")
    names = F.array_join(F.slice("pages", 1, most_named), ", ")
    return question(rows, "shared_detail", F.concat("pages", F.array("property_id")), F.concat(names, F.lit(" share "), F.col("property_id"), F.lit(" "), F.col("value")), F.col("docs"), F.col("ok"))


def person_bridges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Persons between two others that deal with each other. edges: from_page, to_page, n_confirmed, docs."""
    undirected = edges.select(F.least("from_page", "to_page").alias("x"), F.greatest("from_page", "to_page").alias("y"), "n_confirmed", "docs")
    best = undirected.groupBy("x", "y").agg(F.max(F.struct("n_confirmed", F.size("docs"), "docs")).alias("e")).select("x", "y", (F.col("e.n_confirmed") > 0).alias("ok"), F.col("e.docs").alias("docs"))
    found = graph.person_bridges(undirected.select(F.col("x").alias("a"), F.col("y").alias("b")), types)
    for i, (p, q) in enumerate((("person", "a"), ("person", "b"), ("a", "b"))):
        found = found.withColumns({"x": F.least(p, q), "y": F.greatest(p, q)}).join(best.select("x", "y", F.col("ok").alias(f"ok{i}"), F.col("docs").alias(f"docs{i}")), ["x", "y"]).drop("x", "y")
    return question(found, "person_bridges", F.array("person", "a", "b"), F.concat_ws(" ", F.col("person"), F.lit("is between"), F.col("a"), F.lit("and"), F.col("b")), F.concat("docs0", "docs1", "docs2"), F.col("ok0") & F.col("ok1") & F.col("ok2"))


def shared_counterparty(links: DataFrame) -> DataFrame:
    rows = graph.shared_neighbours(links)
    return question(rows, "shared_counterparty", F.array("via"), F.concat(F.col("via"), F.lit(" joins "), F.col("n_pairs").cast("string"), F.lit(" pairs that don't deal with each other")), F.array().cast("array<string>"), F.lit(False))


def circular(edges: DataFrame, most: int = 4) -> DataFrame:
    """Rings of directed relations (a, b)."""
    rows = graph.cycles(edges, most)
    return question(rows, "circular_relation", F.split("nodes", ","), F.concat(F.col("path"), F.lit(" goes round")), F.array().cast("array<string>"), F.lit(False))


def raised(parts: list[DataFrame], judgements: DataFrame, open_only: bool = False) -> DataFrame:
    """All questions with their states: settled ones can be left out."""
    out = judged(reduce(DataFrame.unionByName, parts), judgements)
    return out.where(F.col("status").isin("open", "standing")) if open_only else out


def ranked(questions: DataFrame, limit: int = 50) -> DataFrame:
    """By state, then those confirmed throughout, those with more documents, and the summary."""
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    return questions.orderBy(state, F.desc("confirmed"), F.desc("n_documents"), "summary").limit(limit)
