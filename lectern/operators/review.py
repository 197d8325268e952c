"""Review as events: what a person decides is appended, and the present state is folded from it.

Events are rows of ``EVENTS``. Every verb returns such rows for the ids it is given; nothing is
overwritten. ``fold`` and its kin work out states by one aggregation per row id, so that the
log may be of any length and in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import fingerprint, name_key
from lectern.operators.graph import kept
from lectern.operators.search import Index
from lectern.sources.store import Store

EVENTS = "seq long, table_name string, row_id string, document_id string, action string, new_value string, edited_by string, edited_at timestamp, note string"
#: The status that a decision gives.
STATUS = {"confirm": "confirmed", "amend": "amended", "reject": "rejected", "supersede": "rejected"}
SETTLED = ("resolved", "withdrawn")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def events(rows: DataFrame, action: str, actor: str, at: str, start: int, new_value: Column | None = None, note: str | None = None, table: str = "instances") -> DataFrame:
    """One event for each of rows (row_id, document_id), numbered on from ``start`` in the order of row_id.

    Numbers come from the rows' places in ranges of ids, so that no one task sorts all rows. The
    ranges are written down: worked out twice, they may be cut and put together differently.
    """
    spark = rows.sparkSession
    held = rows.select("row_id", "document_id", (new_value if new_value is not None else F.lit(None).cast("string")).alias("new_value"))
    ranged = held.repartitionByRange("row_id").sortWithinPartitions("row_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.col("part").cast("long") * F.lit(1 << 33))
    ranged = kept(ranged)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    before, total = [], start
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    firsts = F.broadcast(spark.createDataFrame(before or [(0, start)], "part int, first long"))
    numbered = ranged.join(firsts, "part").select((F.col("first") + F.col("at")).alias("seq"), "row_id", "document_id", "new_value")
    return numbered.select("seq", F.lit(table).alias("table_name"), "row_id", "document_id", F.lit(action).alias("action"), "new_value", F.lit(actor).alias("edited_by"), F.lit(at).cast("timestamp").alias("edited_at"), F.lit(note).cast("string").alias("note"))


def same_value(stored: Column, given: Column) -> Column:
    """Whether two written values are equal, as numbers if both are."""
    a, b = stored.try_cast("double"), given.try_cast("double")
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), a == b), F.btrim(stored).eqNullSafe(F.btrim(given)))


def changes(rows: DataFrame, given: DataFrame, declared: list[str]) -> DataFrame:
    """(row_id, new_value): what given (row_id, property_id, value) changes of declared properties of rows (row_id, properties map)."""
    told = given.where(F.col("property_id").isin(declared)).join(rows.select("row_id", "properties"), "row_id")
    changed = told.where(~same_value(F.element_at("properties", F.col("property_id")), F.col("value"))).groupBy("row_id", "property_id").agg(F.max("value").alias("value"))
    return changed.groupBy("row_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_id", "value"))))).alias("new_value"))


def fold(base: DataFrame, log: DataFrame) -> DataFrame:
    """base (row_id, status, confidence, source, properties map) as the log leaves it.

    The last decision gives the status. An amended property has its last value, and an amended
    row is a person's claim: source human, confidence 1.
    """
    decided = F.col("action").isin(list(STATUS))
    last = log.groupBy("row_id").agg(
        F.max_by(F.when(decided, F.col("action")), F.when(decided, F.col("seq"))).alias("last"),
        F.bool_or(F.col("action") == "amend").alias("amended"),
        F.count(F.lit(1)).alias("n_events"),
    )
    each = log.where("action = 'amend'").select("row_id", "seq", F.explode(F.from_json("new_value", "map<string,string>")).alias("k", "v"))
    values = each.groupBy("row_id", "k").agg(F.max_by("v", "seq").alias("v")).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new"))
    out = base.join(last, "row_id", "left").join(values, "row_id", "left")
    amended = F.coalesce("amended", F.lit(False))
    merged = F.map_zip_with("properties", "new", lambda k, a, b: F.coalesce(b, a))
    return out.select(
        "row_id",
        F.coalesce(lookup(STATUS, F.col("last")), "status").alias("status"),
        F.when(amended, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(amended, "human").otherwise(F.col("source")).alias("source"),
        F.when(F.col("new").isNotNull(), merged).otherwise(F.col("properties")).alias("properties"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


#: The status that a decision on a link between instances gives.
EDGE_STATUS = {"edge_confirmed": "confirmed", "edge_amended": "amended", "edge_rejected": "rejected"}


def edge_states(edges: DataFrame, log: DataFrame) -> DataFrame:
    """edges (edge_id, status, link_type_id, source) as the log leaves them: the last decision gives the status. One that names a link type gives that too, and makes the edge amended and a person's."""
    told = log.where(F.col("action").isin(list(EDGE_STATUS))).withColumn("kind", F.get_json_object("new_value", "$.link_type_id"))
    retyped = F.col("kind").isNotNull() & (F.col("kind") != "")
    status = F.when(retyped, "amended").otherwise(lookup(EDGE_STATUS, F.col("action")))
    last = told.groupBy(F.col("row_id").alias("edge_id")).agg(F.max_by(status, "seq").alias("_status"), F.max_by(F.when(retyped, F.col("kind")), F.when(retyped, F.col("seq"))).alias("_kind"), F.count(F.lit(1)).alias("n_events"))
    out = edges.join(last, "edge_id", "left")
    changed = {"status": F.coalesce("_status", "status"), "link_type_id": F.coalesce("_kind", "link_type_id"), "source": F.when(F.col("_kind").isNotNull(), "human").otherwise(F.col("source"))}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in edges.columns], F.coalesce("n_events", F.lit(0)).alias("n_events"))


def row_history(log: DataFrame, row_id: str) -> DataFrame:
    return log.where(F.col("row_id") == row_id).orderBy("seq")


def document_history(log: DataFrame, document_id: str) -> DataFrame:
    return log.where(F.col("document_id") == document_id).orderBy("seq")


def reviewed_documents(log: DataFrame) -> DataFrame:
    """(document_id, reviewed): the last mark that a person set on each document."""
    return log.where("action IN ('mark_reviewed', 'mark_unreviewed')").groupBy("document_id").agg((F.max_by("action", "seq") == "mark_reviewed").alias("reviewed"))


def stale(dependencies: DataFrame, log: DataFrame) -> DataFrame:
    """Evaluations (evaluation_id) of dependencies (evaluation_id, instance_id, made_seq) that an amended or rejected instance has outdated since."""
    moved = log.where("action IN ('amend', 'reject')").groupBy(F.col("row_id").alias("instance_id")).agg(F.max("seq").alias("moved_seq"))
    return dependencies.join(moved, "instance_id").where("moved_seq > made_seq").select("evaluation_id").distinct()


# ---- pages and links ----------------------------------------------------------------------


def linked(log: DataFrame) -> DataFrame:
    """(entity_id, instance_id, status, unlinked) from link events whose new_value is the page: an instance lives on the page it was linked to last."""
    own = log.where("action IN ('link', 'unlink', 'confirm_link')")
    page = F.when(F.col("action") == "link", F.col("new_value"))
    homes = own.groupBy(F.col("row_id").alias("instance_id")).agg(
        F.max_by(page, F.when(page.isNotNull(), F.col("seq"))).alias("entity_id"),
        F.max_by("action", "seq").alias("last"),
        F.max(F.when(F.col("action") == "link", F.col("seq"))).alias("home_seq"),
        F.max(F.when(F.col("action") == "confirm_link", F.col("seq"))).alias("confirmed_seq"),
    )
    confirmed = F.coalesce(F.col("confirmed_seq") > F.col("home_seq"), F.lit(False))
    return homes.where("entity_id IS NOT NULL").select("entity_id", "instance_id", F.when(confirmed, "confirmed").otherwise("unconfirmed").alias("status"), (F.col("last") == "unlink").alias("unlinked"))


def merged(links: DataFrame, merges: DataFrame) -> DataFrame:
    """links with their pages after merges (merge_id, keep_id): live links move to the page that is kept."""
    held = links.join(merges.select(F.col("merge_id").alias("entity_id"), "keep_id"), "entity_id", "left")
    return held.withColumn("entity_id", F.when(~F.col("unlinked"), F.coalesce("keep_id", "entity_id")).otherwise(F.col("entity_id"))).drop("keep_id")


def pages(log: DataFrame, style: str = "organisation") -> DataFrame:
    """(entity_id, canonical_name, name_key, status) from create, rename, confirm and reject events of pages; names are in new_value."""
    named = F.when(F.col("action").isin("create", "rename"), F.col("new_value"))
    decided = F.when(F.col("action").isin("confirm", "reject"), F.col("action"))
    out = log.groupBy(F.col("row_id").alias("entity_id")).agg(F.max_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("canonical_name"), F.max_by(decided, F.when(decided.isNotNull(), F.col("seq"))).alias("last"))
    return out.select("entity_id", "canonical_name", name_key(F.col("canonical_name"), style).alias("name_key"), F.coalesce(lookup(STATUS, F.col("last")), F.lit("unconfirmed")).alias("status"))


# ---- tensions -----------------------------------------------------------------------------


def raised(sides: DataFrame) -> DataFrame:
    """Tensions (subject_id, property_id, n_sides, sides) of sides (subject_id, property_id, value, instance_id): two values at least, one cited instance each."""
    one = sides.groupBy("subject_id", "property_id", "value").agg(F.min("instance_id").alias("instance_id"))
    out = one.groupBy("subject_id", "property_id").agg(F.count(F.lit(1)).alias("n_sides"), F.array_sort(F.collect_list(F.struct("value", "instance_id"))).alias("sides"))
    return out.where("n_sides > 1")


def tension_states(log: DataFrame) -> DataFrame:
    """(tension_id, status): open when raised, then accepted; what is resolved or withdrawn stays so."""
    ended = F.when(F.col("action").isin("resolve", "withdraw"), F.col("action"))
    out = log.groupBy(F.col("row_id").alias("tension_id")).agg(F.min_by(ended, F.when(ended.isNotNull(), F.col("seq"))).alias("end"), F.bool_or(F.col("action") == "accept").alias("accepted"))
    state = F.when(F.col("end") == "resolve", "resolved").when(F.col("end") == "withdraw", "withdrawn").when(F.col("accepted"), "accepted").otherwise("open")
    return out.select("tension_id", state.alias("status"))


def tensions(states: DataFrame, standing: bool | None = None) -> DataFrame:
    return states if standing is None else states.where(F.col("status").isin("open", "accepted") == standing)


def unraised(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Tensions that are not on record yet; one that was withdrawn may be raised again."""
    return found.join(recorded.where("status <> 'withdrawn'").select("subject_id", "property_id"), ["subject_id", "property_id"], "left_anti")


# ---- judgements and offers ----------------------------------------------------------------


def latest_judgement(judgements: DataFrame) -> DataFrame:
    """(fingerprint, status, digest, rationale): the last judgement of each question or pair."""
    return judgements.groupBy("fingerprint").agg(F.max_by(F.struct("status", "digest", "rationale"), "seq").alias("j")).select("fingerprint", "j.*")


def judged(questions: DataFrame, judgements: DataFrame) -> DataFrame:
    """questions (fingerprint, digest, ...) with status and whether the judgement is stale: made of other evidence, it settles nothing."""
    last = latest_judgement(judgements).select("fingerprint", F.col("status").alias("said"), F.col("digest").alias("seen"))
    out = questions.join(last, "fingerprint", "left")
    old = F.col("seen").isNotNull() & (F.col("seen") != F.col("digest"))
    return out.select(*questions.columns, F.when(F.col("said").isNull() | old, "open").otherwise(F.col("said")).alias("status"), F.coalesce(old, F.lit(False)).alias("stale"))


def offers(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """proposed (document_id, page_no, type_id, properties, quote) with a fingerprint, once each, without those offered or settled before."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries("properties")))
    told = proposed.withColumn("fingerprint", fingerprint(F.col("type_id"), ordered, F.col("page_no"), F.col("quote")))
    return told.dropDuplicates(["document_id", "fingerprint"]).join(known.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")


def settled_offers(offered: DataFrame, log: DataFrame) -> DataFrame:
    """offered (suggestion_id, ...) with what became of each: the first decision counts, later ones find nothing to decide. An accepted one names its instance."""
    told = log.where("action IN ('accept_suggestion', 'dismiss_suggestion')").groupBy(F.col("row_id").alias("suggestion_id"))
    first = told.agg(F.min_by(F.struct("action", "edited_by", "edited_at", "new_value"), "seq").alias("d"))
    accepted = F.col("d.action") == "accept_suggestion"
    status = F.when(F.col("d").isNull(), "offered").when(accepted, "accepted").otherwise("dismissed")
    instance = F.when(accepted, F.concat(F.lit("inst_"), F.substring(F.sha2(F.col("suggestion_id").cast("string"), 256), 1, 20)))
    return offered.join(first, "suggestion_id", "left").select(*offered.columns, status.alias("status"), instance.alias("instance_id"), F.col("d.edited_by").alias("decided_by"), F.col("d.edited_at").alias("decided_at"), F.col("d.new_value").alias("given"))


def accepted_instances(settled: DataFrame, declared: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """What accepting makes of settled offers (..., type_id, properties map, quote, engine, confidence): instances with provenance, and what was not declared.

    The values that the person gave (JSON) go over those offered, and ``corrected`` are the
    offered ones that they changed. The instance is the person's and confirmed; the provenance keeps
    the engine, its quotation and its confidence. A type that no bundle declares is not recorded.
    """
    known = F.create_map(*[x for t, ps in declared.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    fine = settled.where("status = 'accepted'").withColumn("wanted", F.element_at(known, F.col("type_id")))
    given = F.coalesce(F.from_json("given", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = fine.where("wanted IS NOT NULL").withColumnRenamed("properties", "offered").withColumn("new", given)
    merged = F.map_zip_with("offered", "new", lambda k, a, b: F.coalesce(b, a))
    kept = F.map_filter(merged, lambda k, v: F.array_contains("wanted", k))
    corrected = F.array_sort(F.map_keys(F.map_filter("new", lambda k, v: ~F.coalesce(F.element_at("offered", k), F.lit("")).eqNullSafe(v))))
    made = rows.select(
        "instance_id", "document_id", "type_id", kept.alias("properties"), "confidence", F.lit("human").alias("source"), F.lit("confirmed").alias("status"), "suggestion_id",
        F.concat(F.lit("companion:"), "engine").alias("source_label"), "page_no", F.col("quote").alias("excerpt"), corrected.alias("corrected"),
    )
    return made, fine.where("wanted IS NULL").select("suggestion_id", "type_id")


def readings(log: DataFrame) -> DataFrame:
    """Per passage and reader: how often it was read, first and last."""
    return log.groupBy("document_id", "page_no", "actor", "engine").agg(F.count(F.lit(1)).alias("n_reads"), F.min("at").alias("first_read"), F.max("at").alias("last_read"))


def passages_read(pages: DataFrame, reads: DataFrame, offered: DataFrame) -> DataFrame:
    """Per document: pages, pages read, the unread ones, and its offers by what became of them."""
    seen = reads.select("document_id", "page_no").distinct().withColumn("seen", F.lit(True))
    out = pages.select("document_id", "page_no").join(seen, ["document_id", "page_no"], "left")
    own = out.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count("seen").alias("n_read"), F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("page_no")))).alias("unread"))
    told = offered.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_offers"), F.count_if(F.col("status") == "accepted").alias("n_accepted"), F.count_if(F.col("status") == "dismissed").alias("n_dismissed"))
    return own.join(told, "document_id", "left").fillna(0, ["n_offers", "n_accepted", "n_dismissed"])


def candidates(log: DataFrame) -> DataFrame:
    """(candidate_id, status, accepted_as) of survey candidates, from accept, rename, reject and reopen events."""
    out = log.groupBy(F.col("row_id").alias("candidate_id")).agg(F.max_by("action", "seq").alias("last"), F.max_by("new_value", "seq").alias("name"))
    status = F.when(F.col("last").isin("accept", "rename"), "accepted").when(F.col("last") == "reject", "rejected").otherwise("proposed")
    return out.select("candidate_id", status.alias("status"), F.when(status == "accepted", F.col("name")).alias("accepted_as"))


# ---- registers ------------------------------------------------------------------------------


def register_states(registers: DataFrame, log: DataFrame) -> DataFrame:
    """(register_id, status, promoted_seq): staged until somebody promotes it, withdrawn if that was last. Promoting what is active already is no event: promoted_seq is the last that was one."""
    told = log.where("table_name = 'registers' AND action IN ('promote', 'withdraw')").select(F.col("row_id").alias("register_id"), "seq", "action")
    before = F.lag("action").over(Window.partitionBy("register_id").orderBy("seq"))
    counted = told.withColumn("real", (F.col("action") == "promote") & ~before.eqNullSafe(F.lit("promote")))
    last = counted.groupBy("register_id").agg(F.max_by("action", "seq").alias("last"), F.max(F.when(F.col("real"), F.col("seq"))).alias("promoted_seq"))
    status = F.when(F.col("last") == "promote", "active").when(F.col("last") == "withdraw", "withdrawn").otherwise("staged")
    return registers.select("register_id").join(last, "register_id", "left").select("register_id", status.alias("status"), "promoted_seq")


def register_row_states(rows: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """rows (register_id, row_no, ...) with their status: what the last review says. A row that is staged when its register is promoted is accepted by that; one that was rejected stays so."""
    told = log.where("table_name = 'register_rows' AND action = 'review'").select(F.split_part("row_id", F.lit(":"), F.lit(1)).alias("register_id"), F.split_part("row_id", F.lit(":"), F.lit(2)).cast(dict(rows.dtypes)["row_no"]).alias("row_no"), "seq", F.get_json_object("new_value", "$.status").alias("said"))
    last = told.groupBy("register_id", "row_no").agg(F.max_by("said", "seq").alias("said"), F.max("seq").alias("said_seq"))
    out = rows.join(last, ["register_id", "row_no"], "left").join(states.select("register_id", "promoted_seq"), "register_id", "left")
    promoted = F.col("promoted_seq").isNotNull() & (F.col("said_seq").isNull() | (F.col("promoted_seq") > F.col("said_seq")))
    status = F.when((F.coalesce("said", F.lit("staged")) == "staged") & promoted, "accepted").otherwise(F.coalesce("said", F.lit("staged")))
    return out.select(*rows.columns, status.alias("status"))


def exposed_keys(log: DataFrame) -> DataFrame:
    """(register_id, key, column): the JSON keys that are columns now: exposed, and not hidden since."""
    told = log.where("action IN ('expose_column', 'hide_column')").groupBy(F.col("document_id").alias("register_id"), F.col("row_id").alias("key"))
    last = told.agg(F.max_by(F.struct("action", "new_value"), "seq").alias("l"))
    return last.where("l.action = 'expose_column'").select("register_id", "key", F.coalesce("l.new_value", F.regexp_replace(F.lower("key"), "[^a-z0-9]+", "_")).alias("column"))


# ---- redaction ------------------------------------------------------------------------------


def redacted_log(log: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The log without the payloads of redacted documents and of their rows; hashes and order stay."""
    gone = documents.select("document_id").withColumn("_d", F.lit(True))
    own = rows.select("row_id").distinct().withColumn("_r", F.lit(True))
    held = log.join(gone, "document_id", "left").join(own, "row_id", "left")
    hidden = F.coalesce("_d", "_r", F.lit(False))
    return held.select(*[F.when(hidden, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("new_value", "previous_value", "note") else F.col(c) for c in log.columns], hidden.alias("payload_redacted"))


def redact(store: Store, documents: DataFrame, texts: dict[str, list[str]], log: str = "log", index: Index | None = None) -> int:
    """Take what documents (document_id) say out of a store for good; its new version.

    texts names the columns of each table (with document_id) that hold what was said: they become
    null. So do the payloads of the log; hashes and order stay. All earlier versions and their files
    go, and the documents' pages leave the index, which is written anew. Rows and ids stay, so that
    whoever reads the present version finds the same rows as before.
    """
    gone = documents.select("document_id").distinct()

    def without(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
        def change(table: DataFrame) -> DataFrame:
            held = table.join(gone.withColumn("_gone", F.lit(True)), "document_id", "left")
            return held.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])

        return change

    changes = {name: without(columns) for name, columns in texts.items()}
    if log in store.tables():
        rows = store.table(log).join(gone, "document_id", "left_semi").select("row_id")
        changes[log] = lambda held: redacted_log(held, gone, rows).select(*held.columns)
    if index is not None and index.exists():
        index.remove(index.texts().join(gone, "document_id", "left_semi"))
        index.compact()
    return store.rewrite(changes)


def orphaned(entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages that no live mention is left on once these documents are gone, though some were."""
    live = mentions.where("NOT unlinked")
    left = live.join(documents.select("document_id"), "document_id", "left_anti").select("entity_id")
    return entities.select("entity_id").join(live.select("entity_id"), "entity_id", "left_semi").join(left, "entity_id", "left_anti")


# ---- access -----------------------------------------------------------------------------------


def shares(log: DataFrame) -> DataFrame:
    """(document_id, actor_id, role) as the last share or unshare event of each pair leaves it; row_id is the actor, new_value the role."""
    out = log.where("action IN ('share', 'unshare')").groupBy("document_id", F.col("row_id").alias("actor_id")).agg(F.max_by(F.struct("action", "new_value"), "seq").alias("l"))
    return out.where("l.action = 'share'").select("document_id", "actor_id", F.col("l.new_value").alias("role"))


def authenticated(tokens: DataFrame, token: str, now: str) -> DataFrame:
    """The actor of a token that is neither revoked nor past its day; only hashes of tokens are kept."""
    live = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return tokens.where((F.col("token_hash") == F.sha2(F.lit(token), 256)) & live).select("actor_id")


def last_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of each group's rows in an order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
