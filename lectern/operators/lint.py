"""The twelve checks of a corpus: each a table of findings (check_name, severity, subject); ``lint`` runs the ones asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import entities, graph
from lectern.operators.entities import conflicts, unlinked, unnamed

SEVERITY = ["high", "medium", "low"]


def finding(rows: DataFrame, check: str, subject, severity="medium") -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(check).alias("check_name"), level.alias("severity"), subject.cast("string").alias("subject"))


def ungrounded_quotations(findings: DataFrame) -> DataFrame:
    return finding(findings.where("alignment IS NULL AND excerpt <> '' AND status <> 'rejected'"), "ungrounded_quotation", F.col("instance_id"), "high")


def smoothed_conflicts(claims: DataFrame, tensions: DataFrame) -> DataFrame:
    """Contested properties of which no tension that still stands or was resolved is on record."""
    known = tensions.where("status <> 'withdrawn'").select(F.col("subject_id").alias("entity_id"), "property_id")
    return finding(conflicts(claims).join(known, ["entity_id", "property_id"], "left_anti"), "smoothed_conflict", F.concat_ws(":", "entity_id", "property_id"), "high")


def unchecked_conflicts(tensions: DataFrame) -> DataFrame:
    return finding(tensions.where("status = 'open'"), "unchecked_conflict", F.concat_ws(":", "subject_id", "property_id"))


def orphan_mentions(mentions: DataFrame) -> DataFrame:
    reviewed = mentions.where("status IN ('confirmed', 'amended')").select("instance_id").distinct()
    return finding(unlinked(reviewed, mentions), "orphan_mention", F.col("instance_id"))


def unreviewed_groupings(mentions: DataFrame, least: int = 3) -> DataFrame:
    own = mentions.where("NOT unlinked").groupBy("entity_id").agg(F.count_distinct("document_id").alias("d"), F.count_if(F.col("status").isin("confirmed", "amended")).alias("r"))
    return finding(own.where((F.col("d") >= least) & (F.col("r") == 0)), "unreviewed_grouping", F.col("entity_id"))


def uncited_pages(pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Live pages without a live mention; high for those that a person confirmed, as they assert something."""
    gone = pages.where("merged_into IS NULL").join(mentions.where("NOT unlinked"), "entity_id", "left_anti")
    level = F.when(F.col("status") == "confirmed", "high").otherwise("medium") if "status" in pages.columns else "medium"
    return finding(gone, "uncited_page", F.col("entity_id"), level)


def split_pages(pages: DataFrame) -> DataFrame:
    """Pages that may be one thing: of a name that several have, each with its smallest page; of different names, the smallest pages of both."""
    members, pairs = entities.duplicate_classes(pages)
    pairs = graph.kept(pairs)
    own = pairs.where("class_id = other_id").select("class_id")
    copies = members.where("entity_id <> class_id").join(own, "class_id", "left_semi").select("class_id", F.col("entity_id").alias("other_id"))
    apart = pairs.where("class_id <> other_id").select("class_id", "other_id")
    return finding(copies.unionByName(apart), "split_page", F.concat_ws(":", "class_id", "other_id"))


def unnamed_pages(pages: DataFrame) -> DataFrame:
    open_ones = pages.where("status NOT IN ('confirmed', 'rejected')") if "status" in pages.columns else pages
    return finding(unnamed(open_ones), "unnamed_page", F.col("entity_id"))


def unextracted_documents(documents: DataFrame, findings: DataFrame) -> DataFrame:
    return finding(documents.select("document_id").join(findings.select("document_id"), "document_id", "left_anti"), "unextracted_document", F.col("document_id"))


def unavailable_originals(audit: DataFrame) -> DataFrame:
    """Originals of audit (doc_id, reason) that are not where they should be; misfiled ones are high."""
    gone = audit.where("reason IN ('missing', 'not_stored', 'misfiled', 'altered')")
    return finding(gone, "unavailable_original", F.col("doc_id"), F.when(F.col("reason") == "misfiled", "high").otherwise("medium"))


def stale_evaluations(evaluations: DataFrame) -> DataFrame:
    return finding(evaluations.where("stale"), "stale_evaluation", F.col("evaluation_id"))


def fragile_joins(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """Cut vertices that no reviewed link holds."""
    cut = graph.kept(graph.articulation_points(links))
    # Only mentions of cut vertices are told apart from each other.
    held = mentions.where("NOT unlinked AND status IN ('confirmed', 'amended')").select(F.col("entity_id").alias("node")).join(cut, "node", "left_semi")
    return finding(cut.join(held, "node", "left_anti"), "fragile_join", F.col("node"))


#: The checks by name, with the tables that each reads; deep ones compare every page or walk the graph.
CHECKS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], bool]] = {
    "ungrounded_quotation": (ungrounded_quotations, ("findings",), False),
    "smoothed_conflict": (smoothed_conflicts, ("claims", "tensions"), False),
    "unchecked_conflict": (unchecked_conflicts, ("tensions",), False),
    "orphan_mention": (orphan_mentions, ("mentions",), False),
    "unreviewed_grouping": (unreviewed_groupings, ("mentions",), False),
    "uncited_page": (uncited_pages, ("pages", "mentions"), False),
    "split_page": (split_pages, ("pages",), True),
    "unnamed_page": (unnamed_pages, ("pages",), False),
    "unextracted_document": (unextracted_documents, ("documents", "findings"), False),
    "unavailable_original": (unavailable_originals, ("audit",), True),
    "stale_evaluation": (stale_evaluations, ("evaluations",), False),
    "fragile_join": (fragile_joins, ("links", "mentions"), True),
}


def lint(tables: dict[str, DataFrame], deep: bool = True, checks: list[str] | None = None) -> DataFrame:
    """Findings of the checks asked for, or of all (the shallow ones if not deep) whose tables are given."""
    wanted = [n for n, (_, needs, is_deep) in CHECKS.items() if (n in checks if checks else deep or not is_deep) and set(needs) <= set(tables)]
    return reduce(DataFrame.unionByName, [CHECKS[n][0](*[tables[t] for t in CHECKS[n][1]]) for n in wanted])


def counted(findings: DataFrame) -> DataFrame:
    """(check_name, severity, n), the gravest first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    return findings.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "check_name")


def headline(findings: DataFrame, n_ran: int) -> DataFrame:
    """One row: findings by severity, and what may be said of the corpus, no more than the checks that ran allow."""
    out = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("n_high"))
    extent = F.lit("all checks" if n_ran == len(CHECKS) else f"{n_ran} of {len(CHECKS)} checks")
    said = F.when(F.col("n") == 0, F.concat(F.lit("nothing found by "), extent)).when(F.col("n_high") > 0, F.concat(F.col("n_high").cast("string"), F.lit(" grave findings by "), extent)).otherwise(F.concat(F.col("n").cast("string"), F.lit(" findings, none grave, by "), extent))
    return out.withColumn("headline", said)
