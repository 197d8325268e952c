"""Review outcomes: accuracy by level, calibration, grounding, corrections, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEWED = ["confirmed", "amended", "rejected"]


def outcome_columns(min_reviewed: int, suppress: Column) -> list[Column]:
    """Counts and rates; rates are null where fewer than min_reviewed were reviewed and suppress holds."""
    status = F.col("status")
    n = F.count_if(status.isin(REVIEWED))
    of = lambda s: F.count_if(status == s)
    shown = (n > 0) & (~suppress | (n >= min_reviewed))
    rate = lambda c: F.when(shown, F.round(c / n, 3))
    total = F.count(F.lit(1))
    return [
        total.alias("n_total"),
        n.alias("n_reviewed"),
        *[of(s).alias(f"n_{s}") for s in REVIEWED],
        F.round(n / total, 3).alias("coverage"),
        rate(of("confirmed")).alias("accuracy"),
        rate(of("amended")).alias("amend_rate"),
        rate(of("rejected")).alias("reject_rate"),
    ]


def outcomes(findings: DataFrame) -> DataFrame:
    """Findings of a machine that state a confidence."""
    return findings.where("source <> 'human' AND confidence IS NOT NULL")


def accuracy_by(findings: DataFrame, key: str, min_reviewed: int = 5) -> DataFrame:
    return outcomes(findings).groupBy(key).agg(*outcome_columns(min_reviewed, F.lit(True)))


def extraction_quality(findings: DataFrame, min_reviewed: int = 5) -> DataFrame:
    """Overall, by type, by confidence and by source in one pass; the overall rates are never suppressed."""
    keys = ["type_id", "confidence", "source"]
    sets = outcomes(findings).groupingSets([[], *[[k] for k in keys]], *keys)
    return sets.agg(*outcome_columns(min_reviewed, F.grouping_id() != 7))


def calibration(findings: DataFrame, min_reviewed: int = 5) -> DataFrame:
    """One row: whether a higher level is a more accurate one, over levels with enough reviews."""
    levels = accuracy_by(findings, "confidence", min_reviewed).where("accuracy IS NOT NULL")
    lower = levels.withColumn("lower", F.lead("accuracy").over(Window.orderBy(F.desc("confidence"))))  # five levels at most
    found = lower.agg(F.count(F.lit(1)).alias("n_levels"), F.count_if(F.col("accuracy") < F.col("lower")).alias("n_inversions"), F.count_distinct("accuracy").alias("_values"))
    verdict = F.when(F.col("n_levels") < 2, "insufficient_evidence").when(F.col("n_inversions") > 0, "inverted").when(F.col("_values") == 1, "flat").otherwise("monotonic")
    return found.select("n_levels", "n_inversions", verdict.alias("verdict"))


def grounding(findings: DataFrame) -> DataFrame:
    """Per source: quotations, those found in their source, those that were not."""
    quoted = findings.where("excerpt <> ''")
    n, bad = F.count(F.lit(1)), F.count_if(F.col("alignment").isNull())
    return quoted.groupBy("source").agg(n.alias("n_quoted"), (n - bad).alias("n_grounded"), bad.alias("n_fabricated"), F.round((n - bad) / n, 3).alias("grounded_rate"))


def concept_precision(findings: DataFrame, min_reviewed: int = 5) -> DataFrame:
    """Per rule: flags raised, reviewed, upheld, dismissed; precision with enough reviews."""
    n, up = F.count_if(F.col("status").isin(REVIEWED)), F.count_if(F.col("status").isin("confirmed", "amended"))
    return findings.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_raised"), n.alias("n_reviewed"), up.alias("n_upheld"), (n - up).alias("n_dismissed"), F.when(n >= min_reviewed, F.round(up / n, 3)).alias("precision"))


def review_outcomes(findings: DataFrame, provenance: DataFrame, flag_type: str = "Flag") -> DataFrame:
    """What machines claimed and people decided: claims (instance_id, confidence, source) with their instance's status and type; flags that rules raised are none."""
    claimed = provenance.where("source <> 'human' AND confidence IS NOT NULL").select("instance_id", "confidence", "source")
    return findings.where(F.col("type_id") != flag_type).select("instance_id", "document_id", "type_id", "status").join(claimed, "instance_id")


def property_corrections(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Per property that amendments changed: how often, and what the latest was and became; the most often amended first."""
    changed = log.where("action = 'amend'").select("row_id", "seq", F.explode(F.from_json("new_value", "map<string,string>")).alias("property_id", "now"))
    was = changed.withColumn("was", F.lag("now").over(Window.partitionBy("row_id", "property_id").orderBy("seq")))
    out = was.groupBy("property_id").agg(F.count(F.lit(1)).alias("n_amended"), F.max_by("was", "seq").alias("was"), F.max_by("now", "seq").alias("latest"))
    return out.orderBy(F.desc("n_amended"), "property_id").limit(limit) if limit else out


def suggestion_quality(offers: DataFrame) -> DataFrame:
    """Offers (engine, status) by what became of them, and the share that was accepted of those decided."""
    of = lambda s: F.count_if(F.col("status") == s)
    decided = of("accepted") + of("dismissed")
    return offers.groupBy("engine").agg(F.count(F.lit(1)).alias("n_offered"), of("accepted").alias("n_accepted"), of("dismissed").alias("n_dismissed"), F.when(decided > 0, F.round(of("accepted") / decided, 3)).alias("acceptance_rate"))


def quality_report(findings: DataFrame, log: DataFrame, min_reviewed: int = 5) -> dict[str, DataFrame]:
    """The tables that say how good an extraction is."""
    return {"outcomes": extraction_quality(findings, min_reviewed), "calibration": calibration(findings, min_reviewed), "grounding": grounding(findings), "rules": concept_precision(findings, min_reviewed), "corrections": property_corrections(log, 25)}


def triage(findings: DataFrame, min_reviewed: int = 5, limit: int = 50) -> DataFrame:
    """The queue of what to review next: levels that unblock a verdict first, documents in turn within a level.

    A level with too few reviews is unblocked by the missing number; only so many of its
    findings stand first, smallest shortfall first. The others follow, fewest reviewed first.
    """
    by = Window.partitionBy("confidence")
    levels = outcomes(findings).groupBy("confidence").agg(F.count_if(F.col("status").isin(REVIEWED)).alias("n_reviewed"), F.count_if(F.col("status") == "unconfirmed").alias("n_waiting"))
    short = F.greatest(F.lit(min_reviewed) - F.col("n_reviewed"), F.lit(0))
    levels = levels.withColumn("shortfall", short).withColumn("unblocks", (F.col("shortfall") > 0) & (F.col("n_reviewed") + F.col("n_waiting") >= min_reviewed))
    waiting = outcomes(findings).where("status = 'unconfirmed'")
    turn = waiting.withColumn("round", F.row_number().over(Window.partitionBy("confidence", "document_id").orderBy("instance_id")))
    # Only the first rounds of each level can be shown: limit bounds every level's share.
    placed = turn.withColumn("place", F.row_number().over(by.orderBy("round", "document_id", "instance_id"))).where(F.col("place") <= limit).join(F.broadcast(levels), "confidence")
    first = F.col("unblocks") & (F.col("place") <= F.col("shortfall"))
    order = [F.desc("first"), F.when(F.col("first"), F.col("shortfall")).otherwise(F.col("n_reviewed")), F.when(F.col("first"), F.col("n_waiting")).otherwise(0), F.desc("confidence"), "place"]
    return placed.withColumn("first", first).orderBy(*order).limit(limit).select("instance_id", "document_id", "confidence", "round", "place", "first")


def best_provenance(findings: DataFrame) -> DataFrame:
    """The strongest claim of each document."""
    return findings.groupBy("document_id").agg(F.max(F.struct("confidence", "instance_id")).alias("b")).select("document_id", F.col("b.confidence").alias("confidence"), F.col("b.instance_id").alias("instance_id"))


def review_progress(findings: DataFrame) -> DataFrame:
    return findings.groupBy("document_id", "status").agg(F.count(F.lit(1)).alias("n"))


def review_queue(findings: DataFrame, provenance: DataFrame, editable: DataFrame, min_reviewed: int = 5, limit: int = 50) -> DataFrame:
    """The triage queue over the documents that somebody may edit, each finding with its strongest claim."""
    own = findings.join(editable.select("document_id"), "document_id", "left_semi")
    queue = triage(own, min_reviewed, limit)
    best = provenance.join(F.broadcast(queue.select("instance_id")), "instance_id", "left_semi").groupBy("instance_id").agg(F.max(F.struct("confidence", "provenance_id", "excerpt")).alias("b"))
    return queue.join(best, "instance_id", "left").select("instance_id", "document_id", queue["confidence"], "place", F.col("b.confidence").alias("claimed"), F.col("b.excerpt").alias("excerpt"))
