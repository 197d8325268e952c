"""Documents as a whole: ingestion, access, registers, rules and scores, redaction, reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

def ingest(docs: DataFrame) -> DataFrame:
    """One row per content: its hash, its place in the store, the first document that has it and how many do."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.groupBy(digest.alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).withColumn("storage_path", F.concat_ws("/", F.lit("documents"), F.substring("file_hash", 1, 2), "file_hash"))


def audit_storage(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """expected (doc_id, file_hash, redacted, storage_path) against stored (doc_id, content_hash, path): what is wrong with each original."""
    reason = F.when(F.col("redacted"), "redacted").when(F.col("file_hash").isNull(), "not_stored").when(F.col("content_hash").isNull(), "missing")
    reason = reason.when(F.col("path") != F.col("storage_path"), "misfiled").when(F.col("content_hash") != F.col("file_hash"), "altered").otherwise("sound")
    return expected.join(stored, "doc_id", "left").select("doc_id", reason.alias("reason"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """(reason, n, fault): faults apart from what is sound or was redacted on purpose."""
    return audit.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("fault", ~F.col("reason").isin("sound", "redacted"))


def ingest_events(documents: DataFrame, actor: str, at: str, start: int) -> DataFrame:
    """An audit event for each new document (doc_id, file_hash)."""
    from lectern.operators.review import events

    return events(documents.select(F.col("file_hash").alias("row_id"), F.col("doc_id").cast("string").alias("document_id")), "ingest", actor, at, start, table="documents")


def visible(docs: DataFrame, shares: DataFrame, actor: str, action: str = "view", admin: bool = False) -> DataFrame:
    """The documents that an actor may see or edit: their own, those open to all, and those shared with them."""
    roles = ["editor"] if action == "edit" else ["editor", "viewer"]
    own = shares.where((F.col("actor_id") == actor) & F.col("role").isin(roles)).select("document_id").distinct().withColumn("_shared", F.lit(True))
    open_to_all = F.col("visibility").isin(["link-edit"] if action == "edit" else ["link-view", "link-edit"])
    allowed = F.lit(admin) | (F.col("owner") == actor) | open_to_all | F.col("_shared")
    return docs.join(own, "document_id", "left").where(F.coalesce(allowed, F.lit(False))).drop("_shared")


def codelist_violations(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.coalesce(column, F.lit("")) != "").where(~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def register_matches(named: DataFrame, register: DataFrame) -> DataFrame:
    """named (entity_id, name_key) against accepted rows (name_key, identifier): one identifier proposes, several are ambiguous."""
    counted = [F.count_distinct("identifier").alias("n_identifiers"), F.min("identifier").alias("identifier")]
    # Identifiers are counted once a name; only entities of several names meet the identifiers themselves.
    names = named.select("entity_id", "name_key").where("name_key IS NOT NULL").distinct()
    names = names.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity_id")))
    one = names.where("_n = 1").join(register.groupBy("name_key").agg(*counted), "name_key").select("entity_id", "n_identifiers", "identifier")
    several = names.where("_n > 1").join(register.select("name_key", "identifier").distinct(), "name_key").groupBy("entity_id").agg(*counted)
    found = one.unionByName(several)
    return found.withColumn("outcome", F.when(F.col("n_identifiers") == 1, "proposal").otherwise("ambiguous"))


def register_rows(rows: DataFrame, key: str, value: str, exposed: list[str] | None = None, status: str | None = None) -> DataFrame:
    """Rows whose JSON values hold a value under a key that was exposed, of a status if one is asked for."""
    if exposed is not None and key not in exposed:
        raise ValueError(f"{key} is not exposed")
    held = rows.where(F.col("status") == status) if status else rows
    return held.where(F.get_json_object("values_json", f"$['{key}']") == value)


def exposed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with JSON keys as columns, for filters that then need no JSON."""
    from lectern.functions.scalar import property_id

    names = rows.sparkSession.range(1).select(*[property_id(F.lit(k)).alias(str(i)) for i, k in enumerate(keys)]).first()
    return rows.withColumns({f"x_{names[i]}": F.get_json_object("values_json", f"$['{k}']") for i, k in enumerate(keys)})


def register_summary(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Per register: rows, rejected ones, and those that have a value under a key."""
    full = F.coalesce(F.get_json_object("values_json", f"$['{key}']"), F.lit("")) != "" if key else F.lit(False)
    return rows.groupBy("register_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "rejected").alias("n_rejected"), F.count_if(full).alias("n_populated"))


def register_evidence(rows: DataFrame, registers: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(entity_id, register_id, row_no, identifier, basis): accepted rows of active registers that bear on pages (entity_id, name_key). A confirmed link is what counts for a page that has one; else equal names that nobody rejected."""
    live = rows.where("status = 'accepted'").join(registers.where("status = 'active'").select("register_id"), "register_id", "left_semi")
    confirmed = links.where("status = 'confirmed'").select("entity_id", "register_id", "row_no")
    linked = confirmed.join(live, ["register_id", "row_no"]).select("entity_id", "register_id", "row_no", "identifier", F.lit("confirmed").alias("basis"))
    named = pages.join(confirmed.select("entity_id"), "entity_id", "left_anti").join(live, "name_key")
    named = named.join(links.where("status = 'rejected'").select("entity_id", "register_id", "row_no"), ["entity_id", "register_id", "row_no"], "left_anti")
    return linked.unionByName(named.select("entity_id", "register_id", "row_no", "identifier", F.lit("name_key").alias("basis")))


def evaluate_concepts(rows: DataFrame, concepts: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """(instance_id, concept_id, fired) for boolean SQL expressions, all in one scan; expressions that don't hold together are returned with the reason."""
    fine, broken = {}, {}
    for name, sql in concepts.items():
        try:
            rows.select(F.expr(sql).cast("boolean")).schema  # noqa: B018
            fine[name] = sql
        except AnalysisException as e:
            broken[name] = str(e).splitlines()[0]
    each = F.array(*[F.struct(F.lit(n).alias("concept_id"), F.coalesce(F.expr(s).cast("boolean"), F.lit(False)).alias("fired")) for n, s in fine.items()])
    return rows.select("instance_id", F.explode(each).alias("c")).select("instance_id", "c.*"), broken


def composite_score(fired: DataFrame, weights: dict[str, int], tiers: dict[str, int]) -> DataFrame:
    """Weighted sum of what fired for each instance, and the highest tier whose threshold it reaches."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("concept_id"))
    total = fired.groupBy("instance_id").agg(F.sum(F.when(F.col("fired"), F.coalesce(weight, F.lit(0))).otherwise(0)).cast("long").alias("total"))
    tier = F.lit(None).cast("string")
    for name, least in sorted(tiers.items(), key=lambda x: x[1]):
        tier = F.when(F.col("total") >= least, name).otherwise(tier)
    return total.withColumn("tier", tier)


def redact(table: DataFrame, document_ids: DataFrame) -> DataFrame:
    """A table without the rows of redacted documents."""
    return table.join(document_ids.select("document_id"), "document_id", "left_anti")


def reading_progress(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, those answered, and the last role."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_answered"), F.max_by("role", "turn").alias("last_role"))


def benchmark_recall(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, item_id): label texts that stand in a document, compared in normalised words.

    A label's first three words in a row, or all of a shorter one, lead to the documents that have them; containment of the whole is then exact.
    """
    from lectern.functions.scalar import words_only

    def grams(text, k):
        hashes = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i - 1 + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
        return F.element_at(F.transform(F.array(F.transform(F.split(text, " "), lambda w: F.xxhash64(w))), hashes), 1)

    label = labels.select("item_id", words_only(F.col("text")).alias("wanted")).where("wanted <> ''").withColumn("k", F.least(F.size(F.split("wanted", " ")), F.lit(3)))
    sizes = sorted(r["k"] for r in label.select("k").distinct().collect())
    first = F.coalesce(*[F.when(F.col("k") == k, F.get(grams(F.col("wanted"), k), F.lit(0))) for k in sizes or [3]])
    label = label.select("item_id", "wanted", first.alias("h"))
    # Documents lead to candidates by hashes alone; their texts are joined back for what was found.
    each = docs.select("doc_id", words_only(F.col("text")).alias("body")).select("doc_id", F.explode(F.array_distinct(F.concat(*[grams(F.col("body"), k) for k in sizes or [3]]))).alias("h"))
    found = each.join(label, "h").select("doc_id", "item_id", "wanted").distinct()
    body = docs.select("doc_id", words_only(F.col("text")).alias("body"))
    told = found.join(body, "doc_id")
    return told.where(F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "wanted", F.lit(" ")))).select("doc_id", "item_id").distinct()


def budget(log: DataFrame, unit: str = "month") -> DataFrame:
    """Spent value per period, and the running total within the year."""
    spent = log.groupBy(F.date_trunc(unit, "edited_at").alias("period")).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    running = F.sum("cents").over(Window.partitionBy(F.year("period")).orderBy("period"))
    return spent.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n_calls", "cents", running.alias("cents_so_far"))


# ---- rules ------------------------------------------------------------------------------------


def effective_parameters(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(template_id, parameter, value, overridden): a deployment's last value where it set one, else the bundle's."""
    last = overrides.groupBy("template_id", "parameter").agg(F.max_by("value", "seq").alias("_own"))
    return defaults.join(last, ["template_id", "parameter"], "left").select("template_id", "parameter", F.coalesce("_own", "value").alias("value"), F.col("_own").isNotNull().alias("overridden"))


def concept_versions(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """held (concept_id, version, sql, status) with wanted (concept_id, sql): a new version only where the SQL changed, the old ones deprecated."""
    newest = held.groupBy("concept_id").agg(F.max("version").alias("_v"), F.max_by("sql", "version").alias("_sql"))
    told = wanted.join(newest, "concept_id", "left")
    new = told.where("_sql IS NULL OR _sql <> sql").select("concept_id", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "sql", F.lit("active").alias("status"))
    old = held.join(new.select("concept_id", F.lit(True).alias("_new")), "concept_id", "left")
    return old.select("concept_id", "version", "sql", F.when(F.col("_new"), "deprecated").otherwise(F.col("status")).alias("status")).unionByName(new)


def new_flags(fired: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags (document_id, target_id, concept_id) for what fired and has no live flag of that rule yet."""
    live = flags.where("status <> 'rejected'").select("document_id", "target_id", "concept_id")
    return fired.where("fired").select("document_id", F.col("instance_id").alias("target_id"), "concept_id").distinct().join(live, ["document_id", "target_id", "concept_id"], "left_anti")


def document_evaluations(evaluations: DataFrame, include_stale: bool = False) -> DataFrame:
    """Per document: evaluations, those that fired, and the rules that did."""
    live = evaluations if include_stale else evaluations.where("NOT stale")
    return live.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_evaluated"), F.count_if("result").alias("n_true"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("result"), F.col("concept_id")))), ",").alias("fired"))


def pinned(components: DataFrame, versions: DataFrame) -> DataFrame:
    """A score's components (score_id, concept_id, weight) with the active version of each rule."""
    active = versions.where("status = 'active'").groupBy("concept_id").agg(F.max("version").alias("version"))
    return components.join(active, "concept_id", "left")


def scored_labels(labels: DataFrame, found: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """labels (title, category, text, present) against found (title, clause_type, text): per category how many were found, texts in one another either way, and the recall over all mapped ones."""
    from lectern.functions.scalar import words_only

    clause = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    told = labels.where("present").withColumn("clause_type", F.element_at(clause, F.col("category"))).withColumn("wanted", words_only(F.col("text")))
    # Different texts are compared once, however many labels and findings have them.
    keys = ["title", "clause_type", "wanted"]
    own = found.select("title", "clause_type", words_only(F.col("text")).alias("held")).where("held <> ''").distinct()
    hit = told.select(*keys).distinct().join(own, ["title", "clause_type"]).where("contains(wanted, held) OR contains(held, wanted)").select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = told.join(hit, keys, "left").groupBy("category", F.col("clause_type").isNotNull().alias("mapped")).agg(F.count(F.lit(1)).alias("n_labelled"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", F.when(F.col("mapped"), F.round(F.col("n_found") / F.col("n_labelled"), 3)))


# ---- documents ------------------------------------------------------------------------------------


def document(docs: DataFrame, pages: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame]:
    """A document's row, and its pages in order."""
    return docs.where(F.col("doc_id") == doc_id), pages.where(F.col("doc_id") == doc_id).orderBy("page_no")


def redacted(docs: DataFrame) -> DataFrame:
    """The tombstones: documents whose text was taken away."""
    return docs.where("redacted_at IS NOT NULL")


def corpus_analysis(instances: DataFrame, mentions: DataFrame, contracts: DataFrame, types: list[str]) -> dict[str, DataFrame]:
    """What other documents say about each document's parties and values: matches per named type, shared identifiers, values against their peers, and whether matching is settled."""
    from lectern.operators.entities import compared_values, identifier_matches, matches_elsewhere

    found = matches_elsewhere(instances, mentions).join(instances.select("instance_id", "type_id").distinct(), "instance_id")
    out = {f"matches_{t}": found.where((F.col("type_id") == t) & (F.col("n_documents") + F.col("n_cross_type") > 0)).drop("type_id") for t in types}
    quality = found.agg(F.when(F.bool_and(F.col("basis") == "reviewed_link"), "resolved").otherwise("naive_unresolved").alias("resolution_quality"))
    return out | {"identifiers": identifier_matches(instances), "values": compared_values(contracts), "quality": quality}
