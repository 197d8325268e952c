"""Extraction as runs: which documents are due, what patterns and an engine make of each, and a ledger of how every run ended.

A run of a tier over many documents is one job. A document is run once in each tier, unless it is
forced; a run that ended partial or failed is due again. The patterns come first and need no
engine: where the engine fails on a document, what they found stays and the run is partial;
where there is nothing else, it has failed. A forced run supersedes what nobody has reviewed of
the tier's earlier findings. ``run`` appends rows and a ledger to a store in one
commit, so that a run that is broken off leaves nothing and a second one repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.extraction import SOURCES, Engine, deterministic_pass, pending, populate
from lectern.operators.text import pages_of
from lectern.sources.store import Store

#: What the tables of a store have, besides those that the caller brings.
FINDINGS = "run_id string, document_id {key}, local_id string, type_id string, properties map<string,array<string>>, quote string, char_start int, char_end int, alignment string, confidence double, source string, status string"
LEDGER = "run_id string, document_id {key}, tier string, engine string, status string, error string, n_deterministic long, n_found long, n_superseded long"
#: An engine may be given another way to run than document by document.
Populator = Callable[[DataFrame, Engine], DataFrame]


@dataclass(frozen=True)
class Run:
    """What a run makes: findings to append, the ids of those superseded, and a ledger row for each document."""

    findings: DataFrame
    superseded: DataFrame
    ledger: DataFrame


def by_patterns(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Dates and amounts as findings (document_id, local_id, ...), without those of a live finding of the same quotation and place."""
    pages = pages_of(documents.select(F.col("document_id").alias("doc_id"), "text"), starts=True)
    none = pages.where("false").select("doc_id", "page_no", F.lit("").alias("raw"))
    made = deterministic_pass(pages, none)
    kind = F.when(F.col("kind") == "date", "KeyDate").otherwise("MonetaryAmount")
    properties = F.map_filter(F.create_map(F.lit("value"), F.array("value"), F.lit("role"), F.array("role"), F.lit("currency"), F.array("currency")), lambda k, v: F.get(v, F.lit(0)).isNotNull())
    told = made.select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("p"), "char_start").alias("local_id"), kind.alias("type_id"), properties.alias("properties"), F.col("raw").alias("quote"),
        F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), "alignment", "confidence",
    )
    live = existing.where("source = 'deterministic' AND status <> 'rejected'").select("document_id", "quote", "char_start")
    return told.join(live, ["document_id", "quote", "char_start"], "left_anti").select(*told.columns)


def made(documents: DataFrame, earlier: DataFrame, ledger: DataFrame, run_id: str, tier: str, engine: Engine, name: str, force: bool = False, patterns: bool = True, populator: Populator = populate, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Run:
    """One run over documents (document_id, text), given the earlier findings and the ledger. ``keep`` holds on to what the engine said, so that it is asked once."""
    source = SOURCES[tier]
    due = pending(documents, ledger, tier, force).select("document_id", "text")
    found = keep(populator(due, engine))
    empty = found.where("false")
    by_rule = keep(by_patterns(due, earlier)) if patterns and tier == "local" else empty.select("document_id", "local_id", "type_id", "properties", "quote", "char_start", "char_end", "alignment", "confidence")
    counts = by_rule.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_deterministic"))
    ends = found.groupBy("document_id").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("n_found"))
    ran_before = ledger.where((F.col("tier") == tier) & (F.col("status") == "complete")).select("document_id").distinct()
    stale = earlier.join(due.select("document_id"), "document_id", "left_semi").join(ran_before, "document_id", "left_semi").where((F.col("source") == source) & (F.col("status") == "unconfirmed"))
    gone = stale.select("run_id", "document_id", "local_id")
    has_text = F.length(F.btrim(F.coalesce("text", F.lit("")))) > 0
    told = due.select("document_id", has_text.alias("has_text"))
    told = told.join(counts, "document_id", "left").join(ends, "document_id", "left").join(gone.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_superseded")), "document_id", "left").fillna(0, ["n_deterministic", "n_found", "n_superseded"])
    error = F.when(~F.col("has_text"), "no text to extract from").otherwise(F.col("error"))
    failed = ~F.col("has_text") | (F.col("error").isNotNull() & (F.col("n_deterministic") == 0))
    status = F.when(failed, "failed").when(F.col("error").isNotNull(), "partial").otherwise("complete")
    rows = told.select(F.lit(run_id).alias("run_id"), "document_id", F.lit(tier).alias("tier"), F.lit(name).alias("engine"), status.alias("status"), error.alias("error"), "n_deterministic", F.when(F.col("error").isNull(), F.col("n_found")).otherwise(0).cast("long").alias("n_found"), "n_superseded")
    # An engine that fails on a document says nothing of it.
    sound = found.join(ends.where("error IS NOT NULL").select("document_id"), "document_id", "left_anti").join(due.where(has_text).select("document_id"), "document_id", "left_semi")
    labelled = lambda df, s: df.select(F.lit(run_id).alias("run_id"), "document_id", "local_id", "type_id", "properties", "quote", "char_start", "char_end", "alignment", "confidence", F.lit(s).alias("source"), F.lit("unconfirmed").alias("status"))
    return Run(labelled(by_rule, SOURCES["deterministic"]).unionByName(labelled(sound, source)), gone, rows)


def run(store: Store, documents: DataFrame, run_id: str, tier: str, engine: Engine, name: str, force: bool = False, patterns: bool = True, populator: Populator = populate) -> DataFrame:
    """The same over a store's tables ``findings`` and ``runs``; the ledger rows that were added, none if nothing was due."""
    spark, key = store.spark, dict(documents.dtypes)["document_id"]
    known = {t: store.table(t) if t in store.tables() else spark.createDataFrame([], s.format(key=key)) for t, s in (("findings", FINDINGS), ("runs", LEDGER))}
    if pending(documents, known["runs"], tier, force).isEmpty():
        return known["runs"].where("false")
    drafts: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        # The engine's answers are written before anything is worked out from them: a lost executor does not ask again.
        drafts.append(f"{store.folder}/_drafts/{run_id}-{len(drafts)}")
        df.write.mode("overwrite").parquet(drafts[-1])
        return spark.read.schema(df.schema).parquet(drafts[-1])

    new = made(documents, known["findings"], known["runs"], run_id, tier, engine, name, force, patterns, populator, keep)
    names = ["run_id", "document_id", "local_id"]
    gone = F.col("_gone").isNotNull()
    held = known["findings"].join(new.superseded.withColumn("_gone", F.lit(True)), names, "left")
    held = held.withColumn("status", F.when(gone, "rejected").otherwise(F.col("status"))).select(*known["findings"].columns)
    if force:
        store.transaction({"findings": held.unionByName(new.findings), "runs": known["runs"].unionByName(new.ledger)})
    else:
        store.transaction({"findings": new.findings, "runs": new.ledger}, append=True)
    for draft in drafts:
        store.drop_folder(draft)
    return store.table("runs").where(F.col("run_id") == run_id)
