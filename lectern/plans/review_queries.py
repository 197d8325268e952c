"""Queries of review events, extraction, history, rules and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, extraction, gate, history, quality, review, runs
from lectern.plans.registry import add
from lectern.session import new_folder
from lectern.sources.store import Store

# ---- events and what they fold to -----------------------------------------------------------


def _folded(f: DataFrame, log: DataFrame) -> DataFrame:
    base = f.select(F.col("instance_id").alias("row_id"), F.lit("unconfirmed").alias("status"), "confidence", "source", F.create_map(F.lit("quantity"), F.col("quantity").cast("string")).alias("properties"))
    return review.fold(base, log).select("row_id", "status", "confidence", "source", F.element_at("properties", "quantity").alias("quantity"), "n_events")


add("folded_reviews", "findings reviews", _folded, """SELECT f.instance_id AS row_id, f.status, CASE WHEN f.status = 'amended' THEN 1e0 ELSE f.confidence END AS confidence, CASE WHEN f.status = 'amended' THEN 'human' ELSE f.source END AS source,
 CASE WHEN f.status = 'amended' THEN (f.quantity + 1)::VARCHAR ELSE f.quantity::VARCHAR END AS quantity, n AS n_events FROM findings f JOIN (SELECT row_id, count(*) AS n FROM reviews GROUP BY 1) r ON r.row_id = f.instance_id""")
add("changed_values", "findings", lambda f: review.changes(f.select(F.col("instance_id").alias("row_id"), F.create_map(F.lit("quantity"), F.col("quantity").cast("string")).alias("properties")), f.select(F.col("instance_id").alias("row_id"), F.lit("quantity").alias("property_id"), F.when(F.col("quantity") > 25, "25").otherwise(F.concat(F.col("quantity").cast("string"), F.lit(".0"))).alias("value")), ["quantity"]),
    "SELECT DISTINCT instance_id AS row_id, '{\"quantity\":\"25\"}' AS new_value FROM findings WHERE quantity > 25")
add("document_history", "reviews", lambda r: review.document_history(r, "doc_1").select("seq", "row_id", "action"), "SELECT seq, row_id, action FROM reviews WHERE document_id = 'doc_1'")
add("confirm_events", "findings", lambda f: review.events(f.where("status = 'unconfirmed'").select(F.col("instance_id").alias("row_id"), "document_id"), "confirm", "ana", "2024-05-01", 1000).select("seq", "row_id", "action", "edited_by"),
    "SELECT 999 + row_number() OVER (ORDER BY instance_id) AS seq, instance_id AS row_id, 'confirm' AS action, 'ana' AS edited_by FROM findings WHERE status = 'unconfirmed'")
add("stale_dependents", "findings reviews", lambda f, r: review.stale(f.select(F.concat(F.lit("e"), "document_id").alias("evaluation_id"), "instance_id", F.lit(0).cast("long").alias("made_seq")), r), "SELECT DISTINCT concat('e', document_id) AS evaluation_id FROM reviews WHERE action IN ('amend', 'reject') AND seq > 0")
add("link_states", "link_events", review.linked, """SELECT max(new_value) AS entity_id, row_id AS instance_id, CASE WHEN count(*) FILTER (action = 'confirm_link') > 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status, count(*) FILTER (action = 'unlink') > 0 AS unlinked FROM link_events GROUP BY row_id""")
add("page_states", "page_events", lambda e: review.pages(e), """, s AS (SELECT row_id, count(*) FILTER (action = 'rename') > 0 AS renamed, max(new_value) FILTER (action = 'create') AS n, max(action) FILTER (action IN ('confirm', 'reject')) AS d FROM page_events GROUP BY 1)
 SELECT row_id AS entity_id, CASE WHEN renamed THEN concat('The ', n, ' Ltd.') ELSE n END AS canonical_name, lower(replace(n, '#', ' ')) AS name_key, CASE d WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE 'unconfirmed' END AS status FROM s""")
add("merged_links", "mentions entities", lambda m, e: review.merged(m.select("entity_id", "instance_id", "unlinked"), e.where("merged_into IS NOT NULL").select(F.col("entity_id").alias("merge_id"), F.col("merged_into").alias("keep_id"))),
    "SELECT CASE WHEN NOT unlinked THEN coalesce(merged_into, entity_id) ELSE entity_id END AS entity_id, instance_id, unlinked FROM mentions JOIN entities USING (entity_id)")
add("tension_states", "orders", lambda o: review.tension_states(o.select(F.concat(F.lit("t"), "o_custkey").alias("row_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "resolve").otherwise("raise").alias("action"))),
    "SELECT concat('t', o_custkey) AS tension_id, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'resolved' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'accepted' ELSE 'open' END AS status FROM orders GROUP BY 1")
add("raised_tensions", "claims tensions", lambda c, t: review.unraised(review.raised(c.where("reviewed AND NOT rejected AND value <> ''").select(F.col("entity_id").alias("subject_id"), "property_id", "value", "instance_id")), t).select("subject_id", "property_id", "n_sides"),
    """SELECT entity_id AS subject_id, property_id, count(DISTINCT value) AS n_sides FROM claims c WHERE reviewed AND NOT rejected AND value <> '' AND NOT EXISTS (SELECT 1 FROM tensions t WHERE t.subject_id = c.entity_id AND t.property_id = c.property_id AND t.status <> 'withdrawn') GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
add("standing_tensions", "tensions", lambda t: review.tensions(t, True).select("tension_id", "status"), "SELECT tension_id, status FROM tensions WHERE status IN ('open', 'accepted')")
add("judged_questions", "customer orders", lambda c, o: review.judged(c.select(F.concat(F.lit("q"), "c_custkey").alias("fingerprint"), F.col("c_mktsegment").alias("digest")), o.select(F.concat(F.lit("q"), "o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "explained").otherwise("standing").alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "old").otherwise(F.lit(None)).alias("digest"), F.lit("r").alias("rationale"))),
    """WITH j AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
 SELECT concat('q', c_custkey) AS fingerprint, c_mktsegment AS digest, CASE WHEN s IS NULL OR p = '5-LOW' THEN 'open' WHEN s = 'F' THEN 'explained' ELSE 'standing' END AS status, coalesce(p = '5-LOW', false) AS stale FROM customer LEFT JOIN j ON o_custkey = c_custkey""")


def _offered(line: DataFrame) -> DataFrame:
    proposed = line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"), F.lit("Clause").alias("type_id"), F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("state"), F.col("l_linestatus")).alias("properties"), F.lit("q").alias("quote"))
    first = review.offers(proposed, proposed.select("document_id", F.lit("").alias("fingerprint")).limit(0))
    again = review.offers(proposed, first.where("properties['flag'] = 'R'"))  # those of flag R were settled
    return again.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_offers"))


add("new_offers", "lineitem", _offered, "SELECT l_orderkey AS document_id, count(DISTINCT (l_linenumber, l_returnflag, l_linestatus)) AS n_offers FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
add("passages_read", "lineitem orders", lambda line, o: review.passages_read(line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no")).distinct(), line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no")), o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("offered").alias("status"))).withColumn("unread", F.array_join(F.col("unread").cast("array<string>"), ",")),
    """WITH p AS (SELECT l_orderkey AS d, l_linenumber AS n, bool_or(l_returnflag = 'R') AS seen FROM lineitem GROUP BY 1, 2)
 SELECT d AS document_id, count(*) AS n_pages, count(*) FILTER (seen) AS n_read, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (NOT seen), '') AS unread, coalesce(any_value(x), 0) AS n_offers, coalesce(any_value(a), 0) AS n_accepted, coalesce(any_value(m), 0) AS n_dismissed
 FROM p LEFT JOIN (SELECT o_orderkey AS d, count(*) AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY 1) USING (d) GROUP BY 1""")
add("passage_readings", "events", lambda e: review.readings(e.select(F.col("user_id").alias("document_id"), F.lit(1).alias("page_no"), F.col("event_type").alias("actor"), F.lit("patterns").alias("engine"), F.col("value").alias("at"))).select("document_id", "actor", "n_reads", "first_read", "last_read"),
    "SELECT user_id AS document_id, event_type AS actor, count(*) AS n_reads, min(value) AS first_read, max(value) AS last_read FROM events GROUP BY 1, 2")
add("candidate_states", "events", lambda e: review.candidates(e.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "rename").when(F.col("event_type") == "error", "reject").otherwise("reopen").alias("action"), F.col("props").alias("new_value"))),
    "SELECT candidate_id, CASE WHEN a IN ('view', 'click') THEN 'accepted' WHEN a = 'error' THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN a IN ('view', 'click') THEN p END AS accepted_as FROM (SELECT user_id AS candidate_id, arg_max(event_type, event_id) AS a, arg_max(props, event_id) AS p FROM events GROUP BY 1)")
add("redacted_history", "reviews", lambda r: review.redacted_log(r, r.where("new_value LIKE '%:\"1%'").select("document_id").distinct(), r.limit(0)).agg(F.count(F.lit(1)).alias("n"), F.count_if("payload_redacted").alias("n_redacted"), F.count("new_value").alias("n_payloads")),
    ", g AS (SELECT DISTINCT document_id FROM reviews WHERE new_value LIKE '%:\"1%') SELECT count(*) AS n, count(*) FILTER (document_id IN (SELECT document_id FROM g)) AS n_redacted, count(new_value) FILTER (document_id NOT IN (SELECT document_id FROM g)) AS n_payloads FROM reviews")
add("orphaned_pages", "entities mentions", lambda e, m: review.orphaned(e, m, m.where("status = 'unconfirmed'").select("document_id").distinct()), ", d AS (SELECT DISTINCT document_id FROM mentions WHERE status = 'unconfirmed') SELECT DISTINCT entity_id FROM mentions WHERE NOT unlinked AND entity_id IN (SELECT entity_id FROM entities) EXCEPT SELECT entity_id FROM mentions WHERE NOT unlinked AND document_id NOT IN (SELECT document_id FROM d)")
add("share_states", "orders", lambda o: review.shares(o.select(F.col("o_orderdate").cast("date").cast("string").alias("document_id"), F.concat(F.lit("u"), F.col("o_custkey") % 20).alias("row_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "unshare").otherwise("share").alias("action"), F.when(F.col("o_orderstatus") == "F", "editor").otherwise("viewer").alias("new_value"))),
    "WITH s AS (SELECT o_orderdate::DATE::VARCHAR AS document_id, concat('u', o_custkey % 20) AS actor_id, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2) SELECT document_id, actor_id, CASE s WHEN 'F' THEN 'editor' ELSE 'viewer' END AS role FROM s WHERE s <> 'P'")
add("authenticated_actor", "customer", lambda c: review.authenticated(c.select(F.concat(F.lit("u"), "c_custkey").alias("actor_id"), F.sha2(F.concat(F.lit("t"), F.col("c_custkey") % 10), 256).alias("token_hash"), F.when(F.col("c_acctbal") < 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("2020-01-01").cast("timestamp")).alias("revoked_at")), "t3", "2024-01-01"),
    "SELECT concat('u', c_custkey) AS actor_id FROM customer WHERE c_custkey % 10 = 3 AND c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'")

# ---- extraction -------------------------------------------------------------------------------
DECLARED = {"Company": ["name", "quantity"], "Clause": ["quantity"]}


def _proposed(f: DataFrame) -> DataFrame:
    held = F.map_from_arrays(F.array(F.lit("name"), F.lit("quantity"), F.lit("colour")), F.array(F.array(F.concat(F.lit("The Part "), F.col("l_partkey").cast("string"), F.lit(" Ltd"))), F.array(F.col("quantity").cast("string"), F.lit("x")), F.array(F.lit("red"))))
    return f.select("instance_id", "document_id", "type_id", held.alias("properties"), (F.col("confidence") + 0.05).alias("confidence"), "source")


add("extracted_instances", "findings", lambda f: extraction.instances(_proposed(f), DECLARED, {"Company": "organisation"}).select("instance_id", "type_id", F.element_at("properties", "quantity").alias("quantity"), F.size("properties").cast("long").alias("n_properties"), "name_key", "confidence"),
    "SELECT instance_id, type_id, concat(quantity, '; x') AS quantity, CASE type_id WHEN 'Company' THEN 2 ELSE 1 END::BIGINT AS n_properties, CASE type_id WHEN 'Company' THEN concat('part ', l_partkey) END AS name_key, confidence FROM findings WHERE type_id IN ('Company', 'Clause')")
add("schema_amendments", "findings", lambda f: extraction.undeclared(_proposed(f), DECLARED).where("property_id IS NULL OR property_id = 'colour'").select("type_id", "property_id", "occurrences"),
    "SELECT type_id, CASE WHEN type_id <> 'KeyDate' THEN 'colour' END AS property_id, CASE WHEN type_id = 'KeyDate' THEN 3 * count(*) ELSE count(*) END AS occurrences FROM findings GROUP BY 1")
add("extracted_edges", "lineitem", lambda line: extraction.edges(line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("from_local"), (F.col("l_linenumber") + 1).alias("to_local"), F.col("l_returnflag").alias("link_type_id")).distinct(), line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("local_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("instance_id")).distinct(), ["A", "R"])[0],
    """WITH i AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n, l_returnflag AS t FROM lineitem WHERE l_returnflag IN ('A', 'R'))
 SELECT r.d AS document_id, concat_ws('-', r.d, r.n) AS from_instance_id, concat_ws('-', i.d, i.n) AS to_instance_id, t AS link_type_id FROM r JOIN i ON r.d = i.d AND i.n = r.n + 1""")
add("filled_containers", "findings", lambda f: extraction.with_container(f.where("type_id = 'KeyDate'").select("instance_id", "document_id", F.when(F.col("quantity") > 40, "kept").alias("contract_id")), f.where("type_id = 'Company'").select("instance_id", "document_id", "confidence", "status"), "contract_id"),
    ", b AS (SELECT document_id, arg_max(instance_id, (confidence, instance_id)) AS best FROM findings WHERE type_id = 'Company' AND status <> 'rejected' GROUP BY 1) SELECT instance_id, f.document_id, CASE WHEN quantity > 40 THEN 'kept' ELSE best END AS contract_id FROM findings f LEFT JOIN b ON b.document_id = f.document_id WHERE type_id = 'KeyDate'")


def _pages(c: DataFrame) -> DataFrame:
    return c.select(F.col("document_id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("Cover page.\n").alias("text")).union(c.select("document_id", F.lit(2), "text")).withColumn("char_count", F.length("text"))


add("deterministic_pass", "contracts", lambda c: extraction.deterministic_pass(_pages(c), c.where("document_id % 3 = 0").select(F.col("document_id").alias("doc_id"), F.lit(2).alias("page_no"), F.col("begun").cast("string").alias("raw"))).select("doc_id", "page_no", "kind", "value", "role", "char_start", "char_end"),
    """SELECT document_id AS doc_id, 2 AS page_no, 'date' AS kind, begun::VARCHAR AS value, 'start' AS role, 40::BIGINT AS char_start, 50::BIGINT AS char_end FROM contracts WHERE document_id % 3 <> 0
 UNION ALL SELECT document_id, 2, 'amount', amount::VARCHAR, 'contract_value', 11 + strpos(text, concat(' ', amount, ' EUR')) + 1, 11 + strpos(text, concat(' ', amount, ' EUR')) + 1 + length(amount::VARCHAR) + 4 FROM contracts""")
add("superseded_rows", "findings", lambda f: extraction.superseded(f, "ai_local"), "SELECT instance_id AS row_id, document_id FROM findings WHERE source = 'ai_local' AND status = 'unconfirmed'")
add("pending_documents", "orders", lambda o: extraction.pending(o.select(F.col("o_orderkey").alias("document_id")), o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "cloud").otherwise("local").alias("tier"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("complete").alias("status")), "local"),
    "SELECT o_orderkey AS document_id FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")


def _stub(text: str) -> list[dict]:
    """An engine for tests and demonstrations: the customer that a contract names, and one claim that it doesn't make."""
    import re

    named = re.search(r"customer \d+", text)
    return [{"type_id": "Company", "properties": {"name": named[0]}, "quote": named[0], "confidence": 0.9}, {"type_id": "Clause", "fields": {"text": "x"}, "quote": "Zebras waive all warranties", "confidence": 1.0}]


add("engine_findings", "contracts", lambda c: extraction.populate(c, _stub).select("document_id", "type_id", F.coalesce("char_start", F.lit(-1)).alias("char_start"), "alignment", "confidence"),
    "SELECT document_id, 'Company' AS type_id, (strpos(text, 'customer ') - 1)::INTEGER AS char_start, 'match_exact' AS alignment, 0.9::DOUBLE AS confidence FROM contracts UNION ALL SELECT document_id, 'Clause', -1::INTEGER, NULL, 0.2::DOUBLE FROM contracts")


def _placed(c: DataFrame) -> DataFrame:
    from lectern.operators.text import page_offsets

    found = extraction.populate(c, _stub).withColumnRenamed("document_id", "doc_id")
    halves = c.select(F.col("document_id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(40).alias("char_count")).union(c.select("document_id", F.lit(2), F.length("text") - 40))
    return extraction.provenance(found, page_offsets(halves), "ai_local").select("doc_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), "excerpt", "alignment")


add("engine_provenance", "contracts", _placed, "SELECT document_id AS doc_id, CASE WHEN strpos(text, 'customer ') > 40 THEN 2 ELSE 1 END AS page_no, regexp_extract(text, 'customer [0-9]+') AS excerpt, 'match_exact' AS alignment FROM contracts UNION ALL SELECT document_id, 0, 'Zebras waive all warranties', NULL FROM contracts")
add("document_types", "documents", lambda d: extraction.classify(d.select(F.col("doc_id").alias("document_id"), "text"), {"licence": ["licen"], "secret": ["token", "password"]}, ["Licence", "Secret"]),
    """WITH t AS (SELECT doc_id, lower(left(coalesce(text, ''), 12000)) AS t FROM documents), n AS (SELECT doc_id, (length(t) - length(replace(t, 'licen', ''))) // 5 AS l, (length(t) - length(replace(t, 'token', ''))) // 5 + (length(t) - length(replace(t, 'password', ''))) // 8 AS s FROM t)
 SELECT doc_id AS document_id, CASE WHEN l > 0 AND l >= s THEN 'licence' WHEN s > 0 THEN 'secret' END AS proposed, CASE WHEN l > 0 AND l >= s THEN 'Licence' WHEN s > 0 THEN 'Secret' ELSE 'other' END AS document_type FROM n""")
add("recorded_facts", "contracts", lambda c: extraction.facts(c.select(F.concat(F.lit("f"), "document_id").alias("fact_id"), "document_id", F.when(F.col("amount") > 100_000, F.expr("substring(text, 6, 30)")).otherwise("no such words here").alias("quote")), c)[0].select("fact_id", "document_id", "start", "status"),
    "SELECT concat('f', document_id) AS fact_id, document_id, 5::INTEGER AS start, 'confirmed' AS status FROM contracts WHERE amount > 100000")

# ---- history ------------------------------------------------------------------------------------
CREATED = "instance_id, confidence, CAST(shipdate AS TIMESTAMP) AS created_at"
add("believed_verdict", "findings reviews", lambda f, r: history.believed_verdict(f.selectExpr(*CREATED.split(", ")), r, "2000-06-30"), f""", i AS (SELECT {CREATED} FROM findings WHERE shipdate <= DATE '2000-06-30'),
 s AS (SELECT row_id, arg_max(action, seq) AS a FROM reviews WHERE edited_at < TIMESTAMP '2000-07-01' AND action <> 'extract' GROUP BY 1), j AS (SELECT confidence, a FROM i LEFT JOIN s ON row_id = instance_id)
 SELECT confidence, count(*) AS n_total, count(a) AS n_reviewed, count(*) FILTER (a = 'confirm') AS n_confirmed, CASE WHEN count(a) >= 5 THEN round(count(*) FILTER (a = 'confirm') / count(a)::DOUBLE, 3) END AS accuracy FROM j GROUP BY 1""")


def _both_axes(f: DataFrame, r: DataFrame, k: DataFrame) -> DataFrame:
    """What was believed by the end of a day, by level, and what was in force on it, by state."""
    told = history.compare(f.selectExpr(*CREATED.split(", ")), r, k, "1997-06-15")
    believed = told["transaction"].select(F.lit("transaction").alias("axis"), F.round(F.col("confidence") * 10).cast("int").cast("string").alias("what"), F.col("n_total").alias("n"), F.col("n_confirmed").alias("m"))
    return believed.unionByName(told["valid"].groupBy(F.col("state").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count_if("reviewed").alias("m")).withColumn("axis", F.lit("valid")))


add("both_axes", "findings reviews key_dates", _both_axes, f""", i AS (SELECT {CREATED} FROM findings WHERE shipdate <= DATE '1997-06-15'),
 s AS (SELECT row_id, arg_max(action, seq) AS a FROM reviews WHERE edited_at < TIMESTAMP '1997-06-16' AND action <> 'extract' GROUP BY 1),
 d AS (SELECT document_id, min(value) FILTER (date_role = 'start') AS b, max(value) FILTER (date_role IN ('end', 'renewal')) AS e, bool_and(status IN ('confirmed', 'amended')) AS reviewed FROM key_dates WHERE status <> 'rejected' GROUP BY 1),
 v AS (SELECT reviewed, CASE WHEN b IS NULL THEN 'unplaceable' WHEN b > DATE '1997-06-15' THEN 'not_yet' WHEN e < DATE '1997-06-15' THEN 'ended' ELSE 'in_force' END AS state FROM d)
 SELECT 'transaction' AS axis, round(confidence * 10)::INTEGER::VARCHAR AS what, count(*) AS n, count(*) FILTER (a = 'confirm') AS m FROM i LEFT JOIN s ON row_id = instance_id GROUP BY confidence
 UNION ALL SELECT 'valid', state, count(*), count(*) FILTER (reviewed) FROM v GROUP BY state""")
add("anchors", "log", lambda k: history.anchors_hold(k.select("seq", F.sha2(F.col("seq").cast("string"), 256).alias("row_hash")), k.select(F.concat(F.lit("a"), "seq").alias("anchor_id"), "seq", F.when(F.col("action") == "reject", F.lit("x")).otherwise(F.sha2(F.col("seq").cast("string"), 256)).alias("row_hash"))),
    "SELECT concat('a', seq) AS anchor_id, seq, action <> 'reject' AS holds FROM log")
add("chain_digest", "log", lambda k: k.select("seq", history.digest(F.lit(None).cast("string"), F.col("seq"), F.col("row_id"), F.col("action"), F.col("new_value")).alias("digest")),
    "SELECT seq, sha256(concat('0:', length(seq::VARCHAR), ':', seq, length(row_id::VARCHAR), ':', row_id, length(action), ':', action, length(new_value), ':', new_value)) AS digest FROM log")
add("upcoming", "orders", lambda o: history.upcoming(_entries(o), "1997-06-15").select("instance_id", "role", "days", "state", "reviewed", "ambiguous"),
    """SELECT concat('k', o_orderkey) AS instance_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'obligation' WHEN '2-HIGH' THEN 'end' ELSE 'milestone' END AS role, date_diff('day', DATE '1997-06-15', o_orderdate::DATE) AS days, CASE WHEN o_orderdate::DATE < DATE '1997-06-15' THEN 'overdue' ELSE 'due' END AS state, o_orderstatus = 'F' AS reviewed, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous
 FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_orderdate::DATE <= DATE '1997-06-15' + 90""")
add("set_aside_dates", "orders", lambda o: history.set_aside(_entries(o)), "SELECT 'start' AS role, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' HAVING count(*) > 0")
add("due_coverage", "orders", lambda o: history.due_coverage(o.select(F.col("o_custkey").alias("document_id")), _entries(o).withColumn("document_id", F.col("custkey"))),
    "WITH d AS (SELECT o_custkey, bool_or(o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') AS due FROM orders GROUP BY 1) SELECT count(*) AS n_documents, count(*) FILTER (due) AS n_with_a_due_date, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS n_obligations, round(count(*) FILTER (due) / count(*)::DOUBLE, 3) AS share FROM d")


def _entries(o: DataFrame) -> DataFrame:
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "obligation").when(F.col("o_orderpriority") == "2-HIGH", "end").when(F.col("o_orderpriority") == "5-LOW", "start").otherwise("milestone")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "rejected").otherwise("unconfirmed")
    return o.select(F.concat(F.lit("k"), "o_orderkey").alias("instance_id"), F.concat(F.lit("doc_"), "o_orderkey").alias("document_id"), F.col("o_custkey").alias("custkey"), role.alias("role"), F.col("o_orderdate").cast("date").alias("value"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"), status.alias("status"))




def _redacted_chain(log: DataFrame) -> DataFrame:
    """The sealed log of which some payloads were taken away: the chain still holds."""
    columns = ["seq", "row_id", "action", "new_value"]
    sealed = history.seal(log.select(*columns), columns)
    hidden = sealed.withColumn("gone", F.col("action") == "amend")
    return history.verify(hidden.withColumn("new_value", F.when(~F.col("gone"), F.col("new_value"))), columns, "gone").select("n_rows", "n_redacted", F.coalesce("first_broken", F.lit(-1)).alias("first_broken"))


add("redacted_chain", "log", _redacted_chain, "SELECT count(*) AS n_rows, count(*) FILTER (action = 'amend') AS n_redacted, -1::BIGINT AS first_broken FROM log")

# ---- rules ------------------------------------------------------------------------------------
add("effective_parameters", "part events", lambda p, e: corpus.effective_parameters(p.select(F.col("p_brand").alias("template_id"), F.lit("least").alias("parameter"), F.lit("10").alias("value")).distinct(), e.select(F.concat(F.lit("Brand#"), F.col("user_id") % 30).alias("template_id"), F.lit("least").alias("parameter"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("value"))),
    "WITH d AS (SELECT DISTINCT p_brand AS t FROM part), o AS (SELECT concat('Brand#', user_id % 30) AS t, arg_max(props ->> '$.k', event_id) AS v FROM events GROUP BY 1) SELECT t AS template_id, 'least' AS parameter, coalesce(v, '10') AS value, v IS NOT NULL AS overridden FROM d LEFT JOIN o USING (t)")
add("concept_versions", "supplier", lambda s: corpus.concept_versions(s.select(F.concat(F.lit("c"), "s_suppkey").alias("concept_id"), F.lit(1).alias("version"), F.col("s_nationkey").cast("string").alias("sql"), F.lit("active").alias("status")), s.select(F.concat(F.lit("c"), "s_suppkey").alias("concept_id"), F.when(F.col("s_acctbal") < 0, "changed").otherwise(F.col("s_nationkey").cast("string")).alias("sql"))),
    "SELECT concat('c', s_suppkey) AS concept_id, 1 AS version, s_nationkey::VARCHAR AS sql, CASE WHEN s_acctbal < 0 THEN 'deprecated' ELSE 'active' END AS status FROM supplier UNION ALL SELECT concat('c', s_suppkey), 2, 'changed', 'active' FROM supplier WHERE s_acctbal < 0")
add("new_flags", "findings", lambda f: corpus.new_flags(f.select("document_id", "instance_id", "concept_id", (F.col("quantity") >= 40).alias("fired")), f.where("quantity >= 45").select("document_id", F.col("instance_id").alias("target_id"), "concept_id", "status")),
    "SELECT DISTINCT document_id, instance_id AS target_id, concept_id FROM findings WHERE quantity >= 40 AND (quantity < 45 OR status = 'rejected')")
add("document_evaluations", "evaluations", lambda e: corpus.document_evaluations(e), "SELECT document_id, count(*) AS n_evaluated, count(*) FILTER (result) AS n_true, coalesce(string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) FILTER (result), '') AS fired FROM evaluations WHERE NOT stale GROUP BY 1")
add("pinned_scores", "supplier", lambda s: corpus.pinned(s.select(F.col("s_nationkey").alias("score_id"), F.concat(F.lit("c"), F.col("s_suppkey") % 40).alias("concept_id"), F.lit(2).alias("weight")).distinct(), s.select(F.concat(F.lit("c"), F.col("s_suppkey") % 30).alias("concept_id"), F.col("s_nationkey").alias("version"), F.when(F.col("s_acctbal") < 2000, "deprecated").otherwise("active").alias("status"))).fillna(-1, ["version"]),
    "WITH a AS (SELECT concat('c', s_suppkey % 30) AS concept_id, max(s_nationkey) AS version FROM supplier WHERE s_acctbal >= 2000 GROUP BY 1) SELECT DISTINCT concat('c', s_suppkey % 40) AS concept_id, s_nationkey AS score_id, 2 AS weight, coalesce(version, -1) AS version FROM supplier LEFT JOIN a ON a.concept_id = concat('c', s_suppkey % 40)")
add("label_recall", "part", lambda p: corpus.scored_labels(p.select(F.col("p_brand").alias("title"), F.col("p_type").alias("category"), F.concat(F.lit("The "), "p_name").alias("text"), (F.col("p_size") > 10).alias("present")), p.select(F.col("p_brand").alias("title"), F.lower("p_type").alias("clause_type"), F.col("p_name").alias("text")), {"ECONOMY": "economy", "SMALL": "small"}),
    """WITH l AS (SELECT p_brand, p_type, p_name FROM part WHERE p_size > 10) SELECT p_type AS category, p_type IN ('ECONOMY', 'SMALL') AS mapped, count(*) AS n_labelled, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN count(*) ELSE 0 END AS n_found, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 1e0 END AS recall FROM l GROUP BY 1, 2""")

# ---- quality ------------------------------------------------------------------------------------
add("review_outcomes", "findings", lambda f: quality.review_outcomes(f, f.where("quantity > 10").select("instance_id", "confidence", F.when(F.col("quantity") > 45, "human").otherwise(F.col("source")).alias("source")).distinct(), "KeyDate").groupBy("type_id", "status", "source").agg(F.count(F.lit(1)).alias("n")),
    ", p AS (SELECT DISTINCT instance_id, confidence, source FROM findings WHERE quantity > 10 AND quantity <= 45) SELECT type_id, f.status, p.source, count(*) AS n FROM findings f JOIN p ON p.instance_id = f.instance_id WHERE type_id <> 'KeyDate' GROUP BY 1, 2, 3")
add("review_queue", "findings", lambda f: quality.review_queue(f, f.select("instance_id", F.concat(F.lit("p"), "instance_id").alias("provenance_id"), "confidence", "excerpt"), f.where("shipdate < DATE'2000-01-01'").select("document_id").distinct()),
    """, d AS (SELECT DISTINCT document_id FROM findings WHERE shipdate < DATE '2000-01-01'), o AS (SELECT * FROM findings WHERE document_id IN (SELECT document_id FROM d)),
 lv AS (SELECT confidence, count(*) FILTER (status IN ('confirmed', 'amended', 'rejected')) AS r, count(*) FILTER (status = 'unconfirmed') AS w FROM o GROUP BY 1),
 t AS (SELECT *, row_number() OVER (PARTITION BY confidence, document_id ORDER BY instance_id) AS round FROM o WHERE status = 'unconfirmed'),
 p AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY round, document_id, instance_id) AS place FROM t),
 q AS (SELECT p.*, r, w, greatest(5 - r, 0) AS s, (r < 5 AND r + w >= 5 AND place <= 5 - r) AS first FROM p JOIN lv USING (confidence))
 SELECT instance_id, document_id, confidence, place::INTEGER AS place, confidence AS claimed, excerpt FROM q ORDER BY first DESC, CASE WHEN first THEN s ELSE r END, CASE WHEN first THEN w ELSE 0 END, confidence DESC, place LIMIT 50""")

# ---- registers ----------------------------------------------------------------------------------
REGISTER = "concat('r', s_nationkey % 5)"


def _register(s: DataFrame) -> DataFrame:
    return s.select(F.expr(REGISTER).alias("register_id"), F.col("s_suppkey").alias("row_no"), F.lower("s_name").alias("name_key"), F.concat(F.lit("id"), "s_suppkey").alias("identifier"), F.to_json(F.struct(F.col("s_name").alias("Company Name"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("nation"))).alias("values_json"), F.when(F.col("s_acctbal") < 0, "rejected").otherwise("accepted").alias("status"))


add("register_by_status", "supplier", lambda s: corpus.register_rows(_register(s), "nation", "7", ["nation"], "accepted").select("row_no"), "SELECT s_suppkey AS row_no FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0")
add("exposed_columns", "supplier", lambda s: corpus.exposed(_register(s), ["Company Name", "nation"]).select("row_no", "x_company_name", "x_nation"), "SELECT s_suppkey AS row_no, s_name AS x_company_name, CASE WHEN s_acctbal > 0 THEN s_nationkey::VARCHAR END AS x_nation FROM supplier")
add("register_summary", "supplier", lambda s: corpus.register_summary(_register(s), "nation"), f"SELECT {REGISTER} AS register_id, count(*) AS n_rows, count(*) FILTER (s_acctbal < 0) AS n_rejected, count(*) FILTER (s_acctbal > 0) AS n_populated FROM supplier GROUP BY 1")
add("register_evidence", "supplier", lambda s: corpus.register_evidence(_register(s), s.select(F.expr(REGISTER).alias("register_id"), F.when(F.expr(REGISTER) == "r0", "staged").otherwise("active").alias("status")).distinct(), s.where("s_acctbal > 8000").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.expr(REGISTER).alias("register_id"), F.col("s_suppkey").alias("row_no"), F.when(F.col("s_acctbal") > 9000, "confirmed").otherwise("rejected").alias("status")), s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lower("s_name").alias("name_key"))),
    f"SELECT concat('s', s_suppkey) AS entity_id, {REGISTER} AS register_id, s_suppkey AS row_no, concat('id', s_suppkey) AS identifier, CASE WHEN s_acctbal > 9000 THEN 'confirmed' ELSE 'name_key' END AS basis FROM supplier WHERE s_nationkey % 5 <> 0 AND s_acctbal >= 0 AND NOT (s_acctbal > 8000 AND s_acctbal <= 9000)")

# ---- calls to models ----------------------------------------------------------------------------


def _calls(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "view", "local").otherwise("cloud").alias("tier"), F.col("event_id").alias("prompt_chars"), F.col("ts").alias("called_at"), F.when(F.col("event_type") == "error", "x").alias("error"))


add("cloud_budget", "events", lambda e: gate.spent(_calls(e), gate.Policy(window="day"), "2024-01-02 10:00:00"), "SELECT count(*) AS n_calls, coalesce(sum(event_id), 0)::BIGINT AS chars FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'")
add("cloud_calls", "events", lambda e: gate.calls_by_document(_calls(e)), "SELECT user_id AS document_id, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_failed, sum(event_id)::BIGINT AS chars FROM events WHERE event_type <> 'view' GROUP BY 1")


# ---- runs of an engine ------------------------------------------------------------------------


def _flaky(text: str) -> list[dict]:
    """The same engine on a bad day: it fails on what began in the first three months."""
    import re

    if re.search(r"\d{4}-0[1-3]-\d\d", text):
        raise TimeoutError("no answer")
    return _stub(text)


def _ledger(c: DataFrame, o: DataFrame) -> DataFrame:
    spark = c.sparkSession
    before = o.select(F.lit("r0").alias("run_id"), F.col("o_orderkey").alias("document_id"), F.lit("local").alias("tier"), F.when(F.col("o_orderpriority") == "1-URGENT", "complete").otherwise("failed").alias("status"))
    earlier = spark.createDataFrame([], runs.FINDINGS.format(key="bigint"))
    return runs.made(c.select("document_id", "text"), earlier, before, "r1", "local", _flaky, "stub").ledger


add("run_ledger", "contracts orders", _ledger, """SELECT 'r1' AS run_id, document_id, 'local' AS tier, 'stub' AS engine, CASE WHEN month(begun) <= 3 THEN 'partial' ELSE 'complete' END AS status,
 CASE WHEN month(begun) <= 3 THEN 'TimeoutError: no answer' END AS error, 2::BIGINT AS n_deterministic, CASE WHEN month(begun) <= 3 THEN 0 ELSE 2 END::BIGINT AS n_found, 0::BIGINT AS n_superseded
 FROM contracts JOIN orders ON o_orderkey = document_id WHERE o_orderpriority <> '1-URGENT'""")


def _stored_runs(c: DataFrame) -> DataFrame:
    """Documents to findings in a store: a bad day, a second try of what is due, and a forced run of the large contracts."""
    store = Store(c.sparkSession, new_folder(c.sparkSession, "runs"))
    documents = c.select("document_id", "text")
    runs.run(store, documents, "r1", "local", _flaky, "stub")
    runs.run(store, documents, "r2", "local", _stub, "stub")
    runs.run(store, c.where("amount > 200000").select("document_id", "text"), "r3", "local", _stub, "stub", force=True)
    return store.table("runs").select("run_id", "document_id", "status", "n_deterministic", "n_found", "n_superseded")


add("stored_runs", "contracts", _stored_runs)

# ---- decisions on edges, offers, documents and registers ----------------------------------------


def _edges_decided(e: DataFrame) -> DataFrame:
    e = e.groupBy("edge_id").agg(F.min("status").alias("status"), F.min("link_type_id").alias("link_type_id"), F.min("confidence").alias("confidence"))  # some ids repeat
    event = lambda rows, seq, action, value: rows.select(F.col("edge_id").alias("row_id"), F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(value).cast("string").alias("new_value"))
    log = event(e.where("status = 'unconfirmed'"), 1, "edge_confirmed", None).union(event(e.where("link_type_id = 'A'"), 2, "edge_confirmed", '{"link_type_id":"AA"}')).union(event(e.where("link_type_id = 'R'"), 3, "edge_rejected", None)).union(event(e.where("confidence < 0.6"), 4, "note", "unsure"))
    return review.edge_states(e.select("edge_id", "status", "link_type_id", F.lit("ai_local").alias("source")), log)


add("edge_states", "edges", _edges_decided, """, e AS (SELECT edge_id, min(status) AS status, min(link_type_id) AS link_type_id FROM edges GROUP BY 1) SELECT edge_id, CASE WHEN link_type_id = 'A' THEN 'amended' WHEN link_type_id = 'R' THEN 'rejected' WHEN status = 'unconfirmed' THEN 'confirmed' ELSE status END AS status,
 CASE WHEN link_type_id = 'A' THEN 'AA' ELSE link_type_id END AS link_type_id, CASE WHEN link_type_id = 'A' THEN 'human' ELSE 'ai_local' END AS source, ((status = 'unconfirmed')::BIGINT + (link_type_id IN ('A', 'R'))::BIGINT) AS n_events FROM e""")


def _settled(line: DataFrame) -> DataFrame:
    """Offers of lines, some decided, some of these twice."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    offered = line.select(
        key.alias("suggestion_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"), F.when(F.col("l_linenumber") == 7, "Riddle").otherwise("Clause").alias("type_id"),
        F.create_map(F.lit("flag"), "l_returnflag", F.lit("state"), "l_linestatus", F.lit("stray"), F.lit("x")).alias("properties"), F.lit("said so").alias("quote"), F.concat(F.lit("e"), "l_linenumber").alias("engine"), F.lit(0.7).alias("confidence"),
    )
    event = lambda rows, seq, action, value: rows.select(key.alias("row_id"), F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(value).cast("string").alias("new_value"), F.lit("ana").alias("edited_by"), F.lit("2024-05-01").cast("timestamp").alias("edited_at"))
    log = event(line.where("l_returnflag = 'A'"), 1, "accept_suggestion", '{"state":"O"}').union(event(line.where("l_returnflag = 'R'"), 2, "dismiss_suggestion", None)).union(event(line.where("l_returnflag <> 'N'"), 3, "accept_suggestion", '{"state":"late"}'))
    return review.settled_offers(offered, log)


add("accepted_offers", "lineitem", lambda line: review.accepted_instances(_settled(line), {"Clause": ["flag", "state"]})[0].select("instance_id", "suggestion_id", "type_id", "status", "source", "source_label", F.to_json("properties").alias("properties"), F.array_join("corrected", ",").alias("corrected")),
    """SELECT DISTINCT 'inst_' || sha256(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber))[1:20] AS instance_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS suggestion_id, 'Clause' AS type_id, 'confirmed' AS status, 'human' AS source, 'companion:e' || l_linenumber AS source_label,
 '{"flag":"A","state":"O"}' AS properties, CASE WHEN l_linestatus <> 'O' THEN 'state' ELSE '' END AS corrected FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 7""")
add("offer_quality", "lineitem", lambda line: quality.suggestion_quality(_settled(line)),
    "SELECT 'e' || l_linenumber AS engine, count(*) AS n_offered, count(*) FILTER (l_returnflag = 'A') AS n_accepted, count(*) FILTER (l_returnflag = 'R') AS n_dismissed, round(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0)::DOUBLE, 3) AS acceptance_rate FROM lineitem GROUP BY 1")
add("reviewed_documents", "events", lambda e: review.reviewed_documents(e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "mark_reviewed").when(F.col("event_type") == "click", "mark_unreviewed").otherwise("confirm").alias("action"))),
    "SELECT user_id AS document_id, arg_max(event_type, event_id) = 'purchase' AS reviewed FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1")


def _register_log(n: DataFrame, c: DataFrame) -> DataFrame:
    register = F.concat(F.lit("n"), "n_nationkey")
    kind = lambda regions, seq, action: n.where(F.col("n_regionkey").isin(regions)).select(F.lit("registers").alias("table_name"), register.alias("row_id"), F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("new_value"))
    row = lambda segment, seq, status: c.where(F.col("c_mktsegment") == segment).select(F.lit("register_rows"), F.concat(F.lit("n"), "c_nationkey", F.lit(":"), "c_custkey"), F.lit(seq), F.lit("review"), F.lit(f'{{"status":"{status}"}}'))
    return kind([1, 2], 100, "promote").union(kind([2], 200, "withdraw")).union(kind([1], 300, "promote")).union(row("BUILDING", 50, "rejected")).union(row("MACHINERY", 150, "staged")).union(row("AUTOMOBILE", 250, "rejected")).union(row("FURNITURE", 60, "staged"))


def _register_states(n: DataFrame, c: DataFrame) -> DataFrame:
    log = _register_log(n, c)
    states = review.register_states(n.select(F.concat(F.lit("n"), "n_nationkey").alias("register_id")), log)
    rows = review.register_row_states(c.select(F.concat(F.lit("n"), "c_nationkey").alias("register_id"), F.col("c_custkey").alias("row_no")), states, log)
    return rows.join(states.select("register_id", F.col("status").alias("register_status")), "register_id")


add("register_states", "nation customer", _register_states, """SELECT concat('n', c_nationkey) AS register_id, c_custkey AS row_no, CASE n_regionkey WHEN 1 THEN 'active' WHEN 2 THEN 'withdrawn' ELSE 'staged' END AS register_status,
 CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'rejected' WHEN c_mktsegment = 'MACHINERY' THEN 'staged' WHEN n_regionkey IN (1, 2) THEN 'accepted' ELSE 'staged' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey""")
add("exposed_keys", "nation", lambda n: review.exposed_keys(n.select(F.lit("r").alias("document_id"), F.col("n_name").alias("row_id"), F.lit(1).alias("seq"), F.lit("expose_column").alias("action"), F.lit(None).cast("string").alias("new_value")).union(n.where("n_regionkey = 3").select(F.lit("r"), "n_name", F.lit(2), F.lit("hide_column"), F.lit(None).cast("string")))),
    "SELECT 'r' AS register_id, n_name AS key, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS \"column\" FROM nation WHERE n_regionkey <> 3")
