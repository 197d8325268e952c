"""The event log: its hash chain, what was believed when, what was in force, what falls due."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = {"confirm": "confirmed", "amend": "amended", "reject": "rejected"}


def digest(previous: Column, *values: Column) -> Column:
    """SHA-256 over each value with its length before it, null as empty: no two rows of different fields run into one text."""
    text = [F.coalesce(v.cast("string"), F.lit("")) for v in (previous, *values)]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def seal(log: DataFrame, columns: list[str]) -> DataFrame:
    """log with prev_hash and row_hash, each row's hash holding the one before it.

    A chain is written in order by its nature: one task streams the sorted rows, holding one
    hash. Verifying is parallel.
    """
    texts = log.select("*", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("_fields"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = ""
        for batch in batches:
            links = []
            for fields in batch["_fields"]:
                payload = "".join(f"{len(x)}:{x}" for x in (before, *fields))
                after = hashlib.sha256(payload.encode()).hexdigest()
                links.append((before or None, after))
                before = after
            yield pd.DataFrame({"_seq": batch["seq"], "prev_hash": [p for p, _ in links], "row_hash": [h for _, h in links]})

    kind = dict(log.dtypes)["seq"]
    sealed = texts.select("seq", "_fields").repartition(1).sortWithinPartitions("seq").mapInPandas(run, f"_seq {kind}, prev_hash string, row_hash string")
    return log.join(sealed, F.col("seq") == F.col("_seq")).drop("_seq")


def verify(log: DataFrame, columns: list[str], redacted: str | None = None) -> DataFrame:
    """One row: rows, unlinked and redacted ones, and the first whose link or content doesn't hold; redacted payloads are trusted, links are not."""
    own = log.withColumn("expected", digest(F.col("prev_hash"), *map(F.col, columns)))
    return first_break(own.withColumn("payload_redacted", F.col(redacted) if redacted else F.lit(False)))


def first_break(log: DataFrame) -> DataFrame:
    """One row: how many rows were looked at, and the first whose link or content doesn't hold.

    log: seq, prev_hash, row_hash, expected, payload_redacted. Each row holds its predecessor's
    hash, so every row is verified by itself against the row before it. A row without a hash is
    unlinked, and what follows it has nothing to hold against. Rows meet in ranges of seq, and the
    row before a range comes from the ranges' last rows, so that no one task sorts the log.
    """
    span = 1 << 16
    ranged = log.withColumn("_range", F.floor(F.col("seq") / span))
    last = ranged.groupBy("_range").agg(F.max_by(F.struct("row_hash"), "seq").alias("l"))
    before = last.select("_range", F.lag("l.row_hash").over(Window.orderBy("_range")).alias("_before"))  # a row for each 65,536 of the log
    order = Window.partitionBy("_range").orderBy("seq")
    linked = ranged.withColumn("_first", F.row_number().over(order) == 1).withColumn("_within", F.lag("row_hash").over(order)).join(before, "_range").withColumn("_prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_within")))
    hashed = F.col("row_hash").isNotNull()
    link = hashed & F.col("_prev").isNotNull() & (F.coalesce("prev_hash", F.lit("")) != F.col("_prev"))
    content = hashed & ~F.col("payload_redacted") & (F.col("row_hash") != F.col("expected"))
    fault = F.when(link, "link").when(content, "content")
    told = linked.withColumn("_fault", fault)
    out = told.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("row_hash").isNull()).alias("n_unlinked"),
        F.count_if(F.col("payload_redacted")).alias("n_redacted"),
        F.min(F.when(F.col("_fault").isNotNull(), F.struct("seq", "_fault"))).alias("b"),
    )
    return out.select("n_rows", "n_unlinked", "n_redacted", F.col("b.seq").alias("first_broken"), F.col("b._fault").alias("kind"))


def head(log: DataFrame) -> DataFrame:
    """The last row of the chain, which an anchor pins: (seq, row_hash)."""
    return log.where("row_hash IS NOT NULL").agg(F.max(F.struct("seq", "row_hash")).alias("h")).select("h.*")


def anchors_hold(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (anchor_id, seq, row_hash) with whether the chain still has that hash in that place."""
    found = log.select("seq", F.col("row_hash").alias("_now"))
    return anchors.join(found, "seq", "left").select("anchor_id", "seq", F.coalesce(F.col("row_hash") == F.col("_now"), F.lit(False)).alias("holds"))


def believed_at(log: DataFrame, when: str) -> DataFrame:
    """Status of every row that existed at a time, by the last decision up to then in seq order."""
    past = log.where(F.col("edited_at") <= F.lit(when).cast("timestamp"))
    decided = F.col("action").isin(list(STATUS))
    last = F.max_by(F.when(decided, F.col("action")), F.when(decided, F.col("seq")))
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("last")), F.lit("unconfirmed"))
    return past.groupBy("row_id").agg(last.alias("last"), F.count(F.lit(1)).alias("n_events")).select("row_id", status.alias("status"), "n_events")


def value_history(log: DataFrame) -> DataFrame:
    """Each change of a property: (row, property, seq, was, became)."""
    each = log.where("new_value IS NOT NULL").select("row_id", "seq", F.explode(F.map_entries(F.from_json("new_value", "map<string,string>"))).alias("e"))
    was = F.lag("e.value").over(Window.partitionBy("row_id", "e.key").orderBy("seq"))
    return each.select("row_id", "seq", F.col("e.key").alias("property_id"), was.alias("was"), F.col("e.value").alias("became"))


def in_force_on(key_dates: DataFrame, day: str) -> DataFrame:
    """Per document: begun by the earliest start, ended by the latest end or renewal, on a day; both inclusive."""
    live = key_dates.where("status <> 'rejected'")
    began = F.min(F.when(F.col("date_role") == "start", F.col("value")))
    finished = F.max(F.when(F.col("date_role").isin("end", "renewal"), F.col("value")))
    seen = live.groupBy("document_id").agg(began.alias("began"), finished.alias("finished"), F.bool_and(F.col("status").isin("confirmed", "amended")).alias("reviewed"))
    on = F.lit(day).cast("date")
    state = F.when(F.col("began").isNull(), "unplaceable").when(F.col("began") > on, "not_yet").when(F.col("finished") < on, "ended").otherwise("in_force")
    return seen.select("document_id", F.col("began").cast("string").alias("began"), F.col("finished").cast("string").alias("finished"), "reviewed", state.alias("state"))


def calendar(key_dates: DataFrame, as_of: str, within_days: int = 90) -> DataFrame:
    """What is overdue before a day, and what falls due in the days from it on; context roles are set aside."""
    day = F.lit(as_of).cast("date")
    live = key_dates.where("status <> 'rejected'").where(~F.col("date_role").isin("start", "signature", "unknown"))
    days = F.datediff("value", day)
    return live.where(days <= within_days).select("document_id", "date_role", F.col("value").cast("string").alias("due"), days.cast("long").alias("days"), F.when(days < 0, "overdue").otherwise("due").alias("state"), F.col("status").isin("confirmed", "amended").alias("reviewed"))


def believed_instances(instances: DataFrame, log: DataFrame, when: str) -> DataFrame:
    """instances (instance_id, confidence, created_at) that existed at a time, with the status that the log gave them by then; a day means its end."""
    bound = F.lit(f"{when} 23:59:59.999999" if len(when) == 10 else when).cast("timestamp")
    known = instances.where(F.col("created_at") <= bound)
    decided = log.where(F.col("edited_at") <= bound).where(F.col("action").isin(list(STATUS)))
    last = decided.groupBy(F.col("row_id").alias("instance_id")).agg(F.max_by("action", "seq").alias("last"))
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("last")), F.lit("unconfirmed"))
    return known.join(last, "instance_id", "left").select("instance_id", "confidence", status.alias("status"))


def believed_verdict(instances: DataFrame, log: DataFrame, when: str, min_reviewed: int = 5) -> DataFrame:
    """Per level as it was at a time: rows, reviewed, confirmed and accuracy where enough were reviewed."""
    told = believed_instances(instances, log, when)
    n = F.count_if(F.col("status") != "unconfirmed")
    up = F.count_if(F.col("status") == "confirmed")
    return told.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_total"), n.alias("n_reviewed"), up.alias("n_confirmed"), F.when(n >= min_reviewed, F.round(up / n, 3)).alias("accuracy"))


def compare(instances: DataFrame, log: DataFrame, key_dates: DataFrame, when: str) -> dict[str, DataFrame]:
    """Both axes at a time: what was believed then, and what was in force then."""
    return {"transaction": believed_verdict(instances, log, when), "valid": in_force_on(key_dates, when[:10])}


#: Roles of dates that nothing falls due on.
CONTEXT_ROLES = ["start", "signature", "unknown"]


def upcoming(entries: DataFrame, as_of: str, within_days: int = 90) -> DataFrame:
    """What is overdue or falls due among entries (instance_id, document_id, role, value, raw, status): dates and obligations, with how sure their reading is."""
    from lectern.functions.scalar import other_reading

    day = F.lit(as_of).cast("date")
    live = entries.where("status <> 'rejected' AND value IS NOT NULL").where(~F.coalesce("role", F.lit("unknown")).isin(CONTEXT_ROLES))
    days = F.datediff(F.col("value").cast("date"), day)
    return live.where(days <= within_days).select("instance_id", "document_id", "role", days.cast("long").alias("days"), F.when(days < 0, "overdue").otherwise("due").alias("state"), F.col("status").isin("confirmed", "amended").alias("reviewed"), other_reading(F.col("raw")).isNotNull().alias("ambiguous"))


def set_aside(entries: DataFrame) -> DataFrame:
    """How many live entries of each context role are no deadlines."""
    live = entries.where("status <> 'rejected' AND value IS NOT NULL").withColumn("role", F.coalesce("role", F.lit("unknown")))
    return live.where(F.col("role").isin(CONTEXT_ROLES)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def due_coverage(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: documents, those with a live date that something falls due on, their share, and obligations."""
    live = entries.where("status <> 'rejected' AND value IS NOT NULL").where(~F.coalesce("role", F.lit("unknown")).isin(CONTEXT_ROLES)).select("document_id").distinct().withColumn("_due", F.lit(True))
    own = documents.select("document_id").distinct().join(live, "document_id", "left").agg(F.count(F.lit(1)).alias("n_documents"), F.count("_due").alias("n_with_a_due_date"))
    obligations = entries.agg(F.count_if(F.col("role") == "obligation").alias("n_obligations"))
    return own.crossJoin(obligations).withColumn("share", F.round(F.col("n_with_a_due_date") / F.nullif("n_documents", F.lit(0)), 3))  # two single rows
