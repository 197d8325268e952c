"""Queries of pages, agreement, the graph around them, and the questions it raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.operators import agreement, bundle, entities, graph, pages, questions, review
from lectern.plans.registry import add

LIVE = "SELECT * FROM mentions WHERE NOT unlinked"

# ---- pages --------------------------------------------------------------------------------------
add("document_instances", "findings", lambda f: pages.document_instances(f.select("instance_id", "document_id", "status"), f.select("instance_id", F.lit("a").alias("provenance_id"), "confidence", "excerpt", "alignment").union(f.select("instance_id", F.lit("b"), F.lit(0.7), F.lit("again"), F.lit("match_exact")))),
    """, p AS (SELECT instance_id, 'a' AS i, confidence, excerpt, alignment FROM findings UNION ALL SELECT instance_id, 'b', 0.7e0, 'again', 'match_exact' FROM findings), b AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY confidence DESC, i) AS k FROM p)
 SELECT f.instance_id, document_id, status, b.confidence AS claimed, b.excerpt, b.alignment FROM findings f JOIN b ON b.instance_id = f.instance_id AND k = 1 WHERE status <> 'rejected'""")
add("page_list", "entities mentions tensions", lambda e, m, t: pages.listed(e, m, t), """, c AS (SELECT entity_id, count(*) AS m, count(DISTINCT document_id) AS d, count(*) FILTER (status IN ('confirmed', 'amended')) AS k FROM mentions WHERE NOT unlinked GROUP BY 1), n AS (SELECT subject_id, count(*) AS n FROM tensions WHERE status IN ('open', 'accepted') GROUP BY 1)
 SELECT e.entity_id, type_id, canonical_name, coalesce(m, 0) AS n_mentions, coalesce(d, 0) AS n_documents, coalesce(k, 0) AS n_confirmed, coalesce(n, 0) AS n_tensions FROM entities e LEFT JOIN c ON c.entity_id = e.entity_id LEFT JOIN n ON subject_id = e.entity_id WHERE merged_into IS NULL""")
add("page_search", "entities mentions", lambda e, m: pages.listed(e, m, query="3 ltd", limit=10), """, c AS (SELECT entity_id, count(*) AS m, count(DISTINCT document_id) AS d, count(*) FILTER (status IN ('confirmed', 'amended')) AS k FROM mentions WHERE NOT unlinked GROUP BY 1)
 SELECT e.entity_id, type_id, canonical_name, coalesce(m, 0) AS n_mentions, coalesce(d, 0) AS n_documents, coalesce(k, 0) AS n_confirmed, 0::BIGINT AS n_tensions FROM entities e LEFT JOIN c ON c.entity_id = e.entity_id WHERE merged_into IS NULL AND contains(lower(canonical_name), '3 ltd') ORDER BY n_documents DESC, canonical_name, entity_id LIMIT 10""")
add("pages_in_document", "mentions entities", pages.in_document, "SELECT DISTINCT document_id, entity_id FROM mentions WHERE NOT unlinked AND entity_id IN (SELECT entity_id FROM entities WHERE merged_into IS NULL)")
VALUES_SQL = """, v AS (SELECT m.entity_id, property_id, value, count(*) AS n_mentions, count(DISTINCT m.document_id) AS n_documents, count(*) FILTER (m.status IN ('confirmed', 'amended')) AS n_confirmed FROM mentions m JOIN claims c ON c.instance_id = m.instance_id WHERE NOT unlinked AND value <> '' GROUP BY 1, 2, 3)"""
add("page_values", "mentions claims", lambda m, c: pages.values(m, c.select("instance_id", "property_id", "value")), VALUES_SQL + " SELECT *, row_number() OVER (PARTITION BY entity_id, property_id ORDER BY n_confirmed DESC, n_mentions DESC, value)::INTEGER AS rank FROM v")
add("page_views", "entities mentions claims", lambda e, m, c: pages.page(e, m, c.select("instance_id", "property_id", "value"), m.select("instance_id", F.concat(F.lit("alias "), F.col("status")).alias("name"))), VALUES_SQL + """, n AS (SELECT entity_id, count(*) AS p, count(*) FILTER (x > 1) AS c FROM (SELECT entity_id, property_id, count(*) AS x FROM v GROUP BY 1, 2) GROUP BY 1),
 k AS (SELECT entity_id, count(*) AS m, count(DISTINCT document_id) AS d, count(*) FILTER (status IN ('confirmed', 'amended')) AS s, string_agg(DISTINCT concat('alias ', status), '|' ORDER BY concat('alias ', status)) AS a FROM mentions WHERE NOT unlinked GROUP BY 1)
 SELECT e.entity_id, canonical_name, coalesce(a, '') AS aliases, coalesce(m, 0) AS n_mentions, coalesce(d, 0) AS n_documents, coalesce(s, 0) AS n_confirmed, coalesce(p, 0) AS n_properties, coalesce(c, 0) AS n_contested, CASE WHEN m > 0 AND m = s THEN 'resolved' ELSE 'naive_unresolved' END AS resolution_quality
 FROM entities e LEFT JOIN k ON k.entity_id = e.entity_id LEFT JOIN n ON n.entity_id = e.entity_id WHERE merged_into IS NULL""")
add("shared_page_values", "claims", lambda c: pages.shared_values_of(c, "c1", "c4"), """, o AS (SELECT DISTINCT entity_id, property_id, value FROM claims WHERE value <> '' AND NOT rejected)
 SELECT property_id, value, count(*) AS n_pages_sharing, (SELECT count(DISTINCT entity_id) FROM o p WHERE p.property_id = o.property_id) AS n_pages_of_type FROM o GROUP BY 1, 2 HAVING count(*) FILTER (entity_id IN ('c1', 'c4')) = 2""")
add("resolution_evidence", "claims mentions", lambda c, m: pages.resolution_evidence(c, m, "c1", "c4").select("n_values", "n_documents"), """, o AS (SELECT DISTINCT entity_id, property_id, value FROM claims WHERE value <> '' AND NOT rejected AND entity_id IN ('c1', 'c4')), d AS (SELECT document_id FROM mentions WHERE NOT unlinked AND entity_id IN ('c1', 'c4') GROUP BY 1 HAVING count(DISTINCT entity_id) = 2)
 SELECT (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY property_id, value HAVING count(*) = 2)) AS n_values, (SELECT count(*) FROM d) AS n_documents""")
CLIENT_VALUES = "stack(3, 'email', email, 'city', city, 'segment', segment) AS (property_id, value)"


def _client_pairs(c: DataFrame, changes: DataFrame, claims: DataFrame) -> DataFrame:
    """Clients and the ones they were merged into: common e-mail, city and segment, sources of changes as documents, segments as registers with the city as number."""
    pairs = c.where("client_id <> master_id").select(F.least("client_id", "master_id").alias("a"), F.greatest("client_id", "master_id").alias("b"))
    mentions = changes.select(F.col("client_id").alias("entity_id"), F.col("source").alias("document_id"))
    return pages.evidence_of_pairs(pairs, claims, mentions, c.select(F.col("client_id").alias("entity_id"), F.col("segment").alias("register_id"), F.col("city").alias("identifier")), ["email"])


def _client_claims(c: DataFrame) -> DataFrame:
    return c.select(F.col("client_id").alias("entity_id"), F.expr(CLIENT_VALUES))


def _client_verdicts(c: DataFrame, changes: DataFrame) -> DataFrame:
    """The evidence as it is now against judgements of every third pair, made before any city was known."""
    now = _client_pairs(c, changes, _client_claims(c))
    before = _client_pairs(c, changes, _client_claims(c).where("property_id <> 'city'"))
    said = before.where("a % 3 = 0").select(F.col("b").alias("seq"), "a", "b", F.when(F.col("a") % 2 == 0, "same").otherwise("distinct").alias("status"), "digest", F.lit("read").alias("rationale"))
    return pages.pair_verdicts(now, said)


PAIRS_SQL = """WITH pr AS (SELECT DISTINCT least(client_id, master_id) AS a, greatest(client_id, master_id) AS b FROM clients WHERE client_id <> master_id),
 own AS (SELECT client_id AS e, 'email' AS p, email AS v FROM clients WHERE email <> '' UNION SELECT client_id, 'city', city FROM clients WHERE city <> '' UNION SELECT client_id, 'segment', segment FROM clients WHERE segment <> ''),
 n AS (SELECT p, v, count(*) AS n FROM own GROUP BY 1, 2), t AS (SELECT p, count(DISTINCT e) AS t FROM own GROUP BY 1),
 vs AS (SELECT a, b, count(*) FILTER (x.p = 'email') AS i, count(*) FILTER (x.p <> 'email') AS v, count(*) FILTER (x.p = 'city') AS c, min(n.n / t.t::DOUBLE) AS r FROM pr JOIN own x ON x.e = a JOIN own y ON y.e = b AND y.p = x.p AND y.v = x.v JOIN n ON n.p = x.p AND n.v = x.v JOIN t ON t.p = x.p GROUP BY 1, 2)"""
add("evidence_of_pairs", "clients client_changes", lambda c, k: _client_pairs(c, k, _client_claims(c)).drop("digest"), PAIRS_SQL + """,
 m AS (SELECT DISTINCT client_id AS e, source AS d FROM client_changes WHERE source IS NOT NULL), ds AS (SELECT a, b, count(*) AS n FROM pr JOIN m x ON x.e = a JOIN m y ON y.e = b AND y.d = x.d GROUP BY 1, 2),
 g AS (SELECT DISTINCT client_id AS e, segment AS r, city AS i FROM clients WHERE segment IS NOT NULL AND city <> ''), gs AS (SELECT a, b, x.r, bool_or(x.i = y.i) AS f FROM pr JOIN g x ON x.e = a JOIN g y ON y.e = b AND y.r = x.r GROUP BY 1, 2, 3),
 gg AS (SELECT a, b, count(*) FILTER (f) AS f, count(*) FILTER (NOT f) AS k FROM gs GROUP BY 1, 2)
 SELECT pr.a, pr.b, coalesce(i, 0) AS n_identifiers, coalesce(v, 0) AS n_values, coalesce(ds.n, 0) AS n_documents, coalesce(gg.f, 0) AS n_registers_for, coalesce(gg.k, 0) AS n_registers_against, r AS rarest
 FROM pr LEFT JOIN vs ON vs.a = pr.a AND vs.b = pr.b LEFT JOIN ds ON ds.a = pr.a AND ds.b = pr.b LEFT JOIN gg ON gg.a = pr.a AND gg.b = pr.b""")
add("pair_verdicts", "clients client_changes", _client_verdicts, PAIRS_SQL + """
 SELECT pr.a, pr.b, CASE WHEN coalesce(c, 0) > 0 THEN 'open' WHEN pr.a % 2 = 0 THEN 'same' ELSE 'distinct' END AS status, coalesce(c, 0) > 0 AS stale FROM pr LEFT JOIN vs ON vs.a = pr.a AND vs.b = pr.b WHERE pr.a % 3 = 0""")
add("reference_cards", "orders", lambda o: pages.resolved(o.select(F.col("o_orderkey").alias("place"), F.concat(F.when(F.col("o_orderstatus") == "F", "doc").when(F.col("o_orderstatus") == "O", "ent").otherwise("zzz"), F.lit("_"), F.col("o_custkey")).alias("ref")), o.where("o_orderstatus <> 'P'").groupBy(F.concat(F.when(F.col("o_orderstatus") == "F", "doc").otherwise("ent"), F.lit("_"), F.col("o_custkey")).alias("ref")).agg(F.max("o_orderpriority").alias("label"), (F.count(F.lit(1)) > 2).alias("visible"), (F.max("o_orderpriority") == "4-NOT SPECIFIED").alias("redacted"))),
    """WITH r AS (SELECT concat(CASE o_orderstatus WHEN 'F' THEN 'doc' WHEN 'O' THEN 'ent' ELSE 'zzz' END, '_', o_custkey) AS ref, o_orderstatus AS s, min(o_orderkey) AS place, max(o_orderpriority) AS label, count(*) AS n FROM orders GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN s = 'P' THEN 'not_found' WHEN n <= 2 THEN 'denied' WHEN label = '4-NOT SPECIFIED' THEN 'redacted' ELSE 'ok' END AS state FROM r)
 SELECT place, ref, CASE s WHEN 'F' THEN 'document' WHEN 'O' THEN 'entity' ELSE 'unknown' END AS kind, state, CASE WHEN state = 'ok' THEN label END AS label FROM t""")
add("reference_search", "part", lambda p: pages.found_refs(p.select(F.concat(F.lit("ent_"), "p_partkey").alias("ref"), F.col("p_name").alias("label"), (F.col("p_size") > 5).alias("visible"), (F.col("p_size") > 45).alias("redacted")), "Widget"), "SELECT concat('ent_', p_partkey) AS ref, p_name AS label FROM part WHERE p_size > 5 AND p_size <= 45 AND contains(lower(p_name), 'widget')")
add("interface_rows", "findings", lambda f: bundle.interface_union(_types(f), NAMED, "Countable"), "SELECT instance_id, type_id, quantity FROM findings WHERE type_id IN ('Company', 'Clause') AND status <> 'rejected'")
add("instance_union", "findings", lambda f: bundle.instance_union(_types(f)).groupBy("type_id", "status").agg(F.count(F.lit(1)).alias("n")), "SELECT type_id, status, count(*) AS n FROM findings GROUP BY 1, 2")
add("canned_query", "findings", lambda f: bundle.canned_query(f.sparkSession, NAMED, "open_work", _types(f)), "SELECT status, count(*) AS n FROM findings GROUP BY 1")
NAMED = bundle.normalise({
    "bundleId": "demo", "bundleVersion": "0.1.0",
    "objects": [{"id": t, "properties": [{"id": "quantity", "type": "integer"}], "implements": ["Countable"] if t != "KeyDate" else [], "table_name": f"instances_{t}"} for t in ("Company", "Clause", "KeyDate")],
    "interfaces": [{"id": "Countable", "properties": ["quantity"]}],
    "queries": [{"id": "open_work", "sql": "SELECT status, count(*) AS n FROM {{instanceUnion}} GROUP BY status"}],
})


def _types(f: DataFrame) -> dict[str, DataFrame]:
    return {t: f.where(F.col("type_id") == t).select("instance_id", "status", "quantity") for t in ("Company", "Clause", "KeyDate")}


# ---- names --------------------------------------------------------------------------------------


def _named_mentions(line: DataFrame, s: DataFrame) -> DataFrame:
    """Mentions of suppliers by order: a person where the line is an odd one, with the names' key."""
    name = F.concat("s_name", F.when(F.col("l_linenumber") % 2 == 0, " Ltd").otherwise(" plc"))
    rows = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("instance_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, "Company").otherwise("Person").alias("type_id"), name.alias("name"), F.col("s_suppkey").alias("s"))
    return rows.withColumn("name_key", scalar.name_key(F.col("name")))


def _elsewhere(line: DataFrame, s: DataFrame) -> DataFrame:
    rows = _named_mentions(line, s)
    links = rows.where("s % 2 = 0").select("instance_id", F.concat(F.lit("p"), (F.col("s") / 4).cast("int")).alias("entity_id"), F.lit("confirmed").alias("status"), F.lit(False).alias("unlinked")).distinct()
    return entities.matches_elsewhere(rows.drop("s"), links).select("instance_id", "basis", "n_documents", "n_cross_type")


add("matches_elsewhere", "lineitem supplier", _elsewhere, """WITH r AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS i, l_orderkey AS d, l_linenumber % 2 AS t, CASE WHEN l_suppkey % 2 = 0 THEN concat('p', l_suppkey // 4) ELSE concat('k', l_suppkey) END AS g, l_suppkey % 2 = 0 AS linked FROM lineitem),
 k AS (SELECT g, t, count(DISTINCT d) AS n FROM r GROUP BY 1, 2), own AS (SELECT DISTINCT g, t, d FROM r)
 SELECT i AS instance_id, CASE WHEN linked THEN 'reviewed_link' ELSE 'naive_key' END AS basis, k.n - 1 AS n_documents, coalesce(x.n, 0) - (o.d IS NOT NULL)::BIGINT AS n_cross_type
 FROM r JOIN k ON k.g = r.g AND k.t = r.t LEFT JOIN k x ON x.g = r.g AND x.t = 1 - r.t LEFT JOIN own o ON o.g = r.g AND o.t = 1 - r.t AND o.d = r.d""")
add("identifier_matches", "lineitem supplier", lambda line, s: entities.identifier_matches(_named_mentions(line, s).withColumn("identifier", F.when(F.col("s") % 3 == 0, F.concat(F.lit("id"), F.col("s") % 7)))),
    "SELECT concat('id', l_suppkey % 7) AS identifier, count(DISTINCT l_orderkey) AS n_documents, count(DISTINCT (l_suppkey, l_linenumber % 2)) AS n_names FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
add("value_against_peers", "orders", lambda o: entities.compared_values(o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("counterparty"), F.when(F.col("o_orderstatus") == "F", "EUR").alias("currency"), F.col("o_totalprice").alias("value"))),
    """WITH o AS (SELECT o_orderkey AS d, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'EUR' END AS e, o_totalprice AS v FROM orders), j AS (SELECT a.d, a.v, count(*) AS n, median(b.v) AS m, max(b.v) AS x, min(b.v) AS y FROM o a JOIN o b ON a.c = b.c AND a.e IS NOT DISTINCT FROM b.e AND a.d <> b.d GROUP BY 1, 2)
 SELECT d AS document_id, v AS value, n AS n_peers, m AS median_value, x AS max_value, y AS min_value, round(v / m, 2) AS ratio FROM j""")
add("mention_candidates", "part supplier", lambda p, s: entities.candidates_for(s.select(F.concat(F.lit("m"), "s_suppkey").alias("instance_id"), F.lit("Company").alias("type_id"), F.concat("s_name", F.lit(" Ltd")).alias("name"), F.when(F.col("s_nationkey") == 7, F.concat(F.lit("id"), "s_suppkey")).alias("identifier")), s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("Company").alias("type_id"), F.col("s_name").alias("canonical_name"), F.concat(F.lit("id"), "s_suppkey").alias("identifier"), F.lit(None).cast("string").alias("merged_into")), bases=["identifier", "naive_key"]).select("instance_id", "entity_id", "basis"),
    "SELECT concat('m', s_suppkey) AS instance_id, concat('s', s_suppkey) AS entity_id, CASE WHEN s_nationkey = 7 THEN 'identifier' ELSE 'naive_key' END AS basis FROM supplier")
# No oracle: likeness of names; brute force in the tests.
add("duplicate_names", "clients", lambda c: entities.duplicate_names(c.select(F.col("segment").alias("type_id"), F.col("name").alias("canonical_name"), F.lit(None).cast("string").alias("merged_into")).fillna("", ["type_id"])))
add("duplicate_offers", "part", lambda p: entities.ranked_offers(entities.first_pairs(*entities.duplicate_classes(p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_brand").alias("type_id"), F.col("p_name").alias("canonical_name"), F.lit(None).cast("string").alias("merged_into")))), p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit(False).alias("unlinked"))))



def _proposed_pages(line: DataFrame, s: DataFrame) -> DataFrame:
    rows = _named_mentions(line, s).withColumn("identifier", F.when(F.col("s") % 5 == 0, F.concat(F.lit("id"), F.col("s") % 7)))
    held = s.where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.lpad("s_suppkey", 9, "0")).alias("entity_id"), F.lit("").alias("identifier"), scalar.name_key(F.col("s_name")).alias("name_key"))
    return entities.attached(entities.propose(rows, scoped=["Person"]), held).groupBy("basis", F.col("entity_id").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_mentions").alias("n_mentions"))


add("proposed_pages", "lineitem supplier", _proposed_pages, """WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'document' WHEN l_suppkey % 5 = 0 THEN 'identifier' ELSE 'name_key' END AS basis, CASE WHEN l_linenumber % 2 = 1 THEN concat(l_orderkey, ':', l_suppkey) WHEN l_suppkey % 5 = 0 THEN concat('id', l_suppkey % 7) ELSE concat('k', l_suppkey) END AS g, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 5 <> 0 THEN s_acctbal > 5000 ELSE false END AS known FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
 SELECT basis, known, count(DISTINCT g) AS n_pages, count(*) AS n_mentions FROM r GROUP BY 1, 2""")
add("merge_chains_long", "part", lambda p: entities.follow_merges(p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("entity_id"), F.when(F.col("p_partkey") % 50 != 0, F.lpad((F.col("p_partkey") - 1).cast("string"), 9, "0")).alias("merged_into"))),
    "SELECT lpad(p_partkey::VARCHAR, 9, '0') AS entity_id, lpad((p_partkey - p_partkey % 50)::VARCHAR, 9, '0') AS survivor FROM part")

# ---- agreement ----------------------------------------------------------------------------------
# One letter differs between two excerpts of one value: they are one wording if it is a small enough part of the text.
WORDS_SQL = """, o AS (SELECT * FROM claims WHERE NOT rejected AND value <> ''), g AS (SELECT entity_id, property_id, value, count(DISTINCT document_id) AS d, count(DISTINCT excerpt) AS e, any_value(length(regexp_replace(excerpt, '\\W+', ' ', 'g'))) AS n FROM o GROUP BY 1, 2, 3 HAVING count(DISTINCT document_id) >= 2),
 w AS (SELECT entity_id, property_id, value, d, CASE WHEN (n - 1) / n::DOUBLE >= 0.92 THEN 1 ELSE e END AS w FROM g)"""
add("corroborated_wordings", "claims", lambda c: agreement.corroborated_values(c).select("entity_id", "property_id", "value", "n_documents", "n_wordings", "independent", "note", "n_other_values"), WORDS_SQL + """
 SELECT entity_id, property_id, value, d AS n_documents, w AS n_wordings, w >= 2 AS independent, CASE WHEN w = 1 THEN 'one wording, copied' WHEN w < d THEN 'some copied' ELSE 'each its own' END AS note, (SELECT count(DISTINCT value) - 1 FROM o WHERE o.entity_id = w.entity_id AND o.property_id = w.property_id) AS n_other_values FROM w""")
add("agreement_summary", "claims", lambda c: agreement.summary(agreement.corroborated_values(c)), WORDS_SQL + " SELECT count(*) AS n_values, count(*) FILTER (w >= 2) AS n_independent, count(*) FILTER (w < 2) AS n_copied, count(DISTINCT entity_id) AS n_pages FROM w")


def _statements(e: DataFrame, m: DataFrame, p: DataFrame) -> DataFrame:
    return agreement.corroborated_relations(graph.statements(e, m, p).select("from_page", "link_type_id", "to_page", "document_id", F.concat(F.lit("said in "), F.col("status")).alias("excerpt")))


# "said in confirmed" and "said in unconfirmed" are alike enough to be one wording.
add("corroborated_relations", "edges mentions entities", lambda e, m, p: _statements(e, m, p).select("from_page", "link_type_id", "to_page", "n_documents", "n_wordings"), """, live AS (SELECT instance_id, coalesce(merged_into, entity_id) AS page FROM mentions JOIN entities USING (entity_id) WHERE NOT unlinked)
 SELECT f.page AS from_page, link_type_id, t.page AS to_page, count(DISTINCT document_id) AS n_documents, 1::BIGINT AS n_wordings FROM edges JOIN live f ON from_instance_id = f.instance_id JOIN live t ON to_instance_id = t.instance_id WHERE status <> 'rejected' AND f.page <> t.page GROUP BY 1, 2, 3 HAVING count(DISTINCT document_id) >= 2""")
add("conflict_sides", "claims", agreement.conflict_sides, ", k AS (SELECT entity_id, property_id FROM claims WHERE reviewed AND NOT rejected AND value <> '' GROUP BY 1, 2 HAVING count(DISTINCT value) > 1) SELECT entity_id, property_id, value, min(instance_id) AS instance_id FROM claims JOIN k USING (entity_id, property_id) WHERE reviewed AND NOT rejected AND value <> '' GROUP BY 1, 2, 3")
SIDES = ", s AS (SELECT tension_id, document_id, instance_id, status FROM tensions JOIN claims ON entity_id = subject_id AND claims.property_id = tensions.property_id WHERE reviewed AND NOT rejected AND value <> '')"


def _sides(t: DataFrame, c: DataFrame) -> DataFrame:
    own = c.where("reviewed AND NOT rejected AND value <> ''").select(F.col("entity_id").alias("subject_id"), "property_id", "document_id", "instance_id")
    return t.join(own, ["subject_id", "property_id"])


add("tensions_of_documents", "tensions claims", lambda t, c: agreement.tensions_of_documents(_sides(t, c)), SIDES + " SELECT document_id, count(DISTINCT tension_id) AS n_tensions FROM s WHERE status IN ('open', 'accepted') GROUP BY 1")
add("tensions_of_instances", "tensions claims", lambda t, c: agreement.tensions_of_instances(_sides(t, c)), SIDES + " SELECT instance_id, string_agg(DISTINCT tension_id, ',' ORDER BY tension_id) AS tensions FROM s WHERE status IN ('open', 'accepted') GROUP BY 1")

# ---- graph --------------------------------------------------------------------------------------
def _around(k: DataFrame) -> DataFrame:
    k = graph.kept(k)  # looked at for its first node, at each hop and for its links
    return graph.induced(k, graph.neighbourhood(k, k.agg(F.min("a")).first()[0], 2))


LABELS = "(SELECT node, (substr(node, 2)::BIGINT % 7)::VARCHAR AS community FROM (SELECT a AS node FROM links UNION SELECT b FROM links))"
BOTH = f", both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), l AS {LABELS}, k AS (SELECT x.a, x.b, p.community AS ca, q.community AS cb FROM both_ways x JOIN l p ON p.node = x.a JOIN l q ON q.node = x.b)"


def _labels(k: DataFrame) -> DataFrame:
    nodes = graph.neighbours(k).select(F.col("a").alias("node")).distinct()
    return nodes.withColumn("community", (F.expr("cast(substring(node, 2) AS bigint)") % 7).cast("string"))


add("component_summaries", "links entities", lambda k, e: graph.described(graph.components(k), e.select(F.col("entity_id").alias("node"), F.col("canonical_name").alias("name"), "type_id"), k).select("component", "n_nodes", "types", "label"), """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r(node, reach) AS (SELECT a, a FROM both_ways UNION SELECT r.node, b FROM r JOIN both_ways ON r.reach = a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1),
 d AS (SELECT a, count(*) AS degree FROM both_ways GROUP BY 1), t AS (SELECT component, node, type_id, canonical_name AS name, degree FROM c JOIN entities ON entity_id = node JOIN d ON d.a = node)
 SELECT component, count(*) AS n_nodes, (SELECT string_agg(concat(type_id, ':', n), ',' ORDER BY type_id) FROM (SELECT type_id, count(*) AS n FROM t u WHERE u.component = t.component GROUP BY 1)) AS types, arg_min(name, (-degree, name, node)) AS label FROM t GROUP BY component""")
add("community_bridges", "links", lambda k: graph.bridges(k, _labels(k)), BOTH + " SELECT a AS node, ca AS community, count(DISTINCT cb) AS n_communities, count(*) AS n_links FROM k WHERE ca <> cb GROUP BY 1, 2")
add("community_connections", "links", lambda k: graph.connections(k, _labels(k)), BOTH + " SELECT ca AS \"left\", cb AS \"right\", count(*) AS n_links FROM k WHERE ca < cb GROUP BY 1, 2")
add("communities_apart", "links", lambda k: graph.unconnected(k, _labels(k)), BOTH + ", n AS (SELECT count(DISTINCT community) AS n FROM l), t AS (SELECT count(DISTINCT (ca, cb)) AS t FROM k WHERE ca < cb) SELECT n AS n_communities, n * (n - 1) // 2 AS n_pairs, t AS n_touching, n * (n - 1) // 2 - t AS n_apart FROM n, t")
add("community_modularity", "links", lambda k: graph.modularity(k, _labels(k)), BOTH + ", e AS (SELECT ca, count(*) AS ends, count(*) FILTER (ca = cb) AS inside FROM k GROUP BY 1) SELECT round(sum(inside) / sum(ends)::DOUBLE - sum(ends::DOUBLE * ends) / (sum(ends)::DOUBLE * sum(ends)), 4) AS modularity, count(*) AS n_communities, CASE WHEN round(sum(inside) / sum(ends)::DOUBLE - sum(ends::DOUBLE * ends) / (sum(ends)::DOUBLE * sum(ends)), 4) >= 0.3 THEN 'strong' ELSE 'weak' END AS reading FROM e")
add("highest_degrees", "links", lambda k: graph.capped(graph.degrees(k), 20, F.desc("degree"), "node"), ", both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), d AS (SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY 1) SELECT node, degree, (SELECT count(*) FROM d) AS n_total FROM d ORDER BY degree DESC, node LIMIT 20")
add("neighbourhood_links", "links", _around, """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), s AS (SELECT min(a) AS n FROM links), one AS (SELECT n AS node FROM s UNION SELECT b FROM both_ways JOIN s ON a = n), two AS (SELECT node FROM one UNION SELECT b FROM both_ways JOIN one ON a = node)
 SELECT DISTINCT a, b FROM both_ways WHERE a < b AND a IN (SELECT node FROM two) AND b IN (SELECT node FROM two)""")
add("triangle_counts", "relations", lambda k: graph.triangles(k).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")), """, u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM relations), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b)
 SELECT unnest([a, b, c]) AS node, count(*) AS n FROM t GROUP BY 1""")
PATHS = """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), s AS (SELECT min(a) AS f, min(b) AS t FROM links), w1 AS (SELECT f, b AS n1 FROM s JOIN both_ways ON a = f),
 p AS (SELECT concat_ws('>', f, n1) AS path, 1::BIGINT AS length FROM w1 WHERE n1 = (SELECT t FROM s) UNION ALL SELECT concat_ws('>', f, n1, b), 2 FROM w1 JOIN both_ways ON a = n1 WHERE n1 <> (SELECT t FROM s) AND b = (SELECT t FROM s)
 UNION ALL SELECT concat_ws('>', f, n1, x.b, y.b), 3 FROM w1 JOIN both_ways x ON x.a = n1 JOIN both_ways y ON y.a = x.b WHERE y.b = (SELECT t FROM s) AND n1 <> (SELECT t FROM s) AND x.b NOT IN (f, n1, (SELECT t FROM s)))"""


def _between(k: DataFrame, hops: int, paths: int | None = None) -> DataFrame:
    k = graph.kept(k)  # looked at for its first nodes and its paths
    first = k.agg(F.min("a"), F.min("b")).first()
    return graph.paths_between(k, first[0], first[1], hops, paths)


add("short_paths", "links", lambda k: _between(k, 3), PATHS + " SELECT path, length FROM p")
# The first five of up to six hops; three hops have more than five at every size, so that the oracle needs no more.
add("paths_between", "links", lambda k: _between(k, 6, 5), PATHS + " SELECT path, length FROM p ORDER BY length, string_split(path, '>') LIMIT 5")

# ---- questions ----------------------------------------------------------------------------------


def _parts(line: DataFrame) -> DataFrame:
    return questions.two_parts(line.select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_suppkey").cast("string").alias("entity_id"), F.col("l_returnflag").alias("part"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("unconfirmed").alias("status")))


def _details(s: DataFrame) -> DataFrame:
    return questions.shared_detail(s.select(F.lit("Company").alias("type_id"), F.lit("nation").alias("property_id"), F.concat(F.lit(" N"), "s_nationkey").alias("value"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), (F.col("s_suppkey") % 3).cast("string").alias("document_id"), F.lit("confirmed").alias("status")))


add("two_parts_questions", "lineitem", lambda line: _parts(line).select("kind", "summary", "entities", "confirmed"), """SELECT 'two_parts_in_one_document' AS kind, concat(l_suppkey, ' is ', string_agg(DISTINCT l_returnflag, ' and ' ORDER BY l_returnflag), ' of ', l_orderkey) AS summary, concat_ws(',', least(l_suppkey::VARCHAR, l_orderkey::VARCHAR), greatest(l_suppkey::VARCHAR, l_orderkey::VARCHAR)) AS entities, bool_and(l_linestatus = 'F') AS confirmed FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_returnflag) > 1""")
add("shared_detail_questions", "supplier", lambda s: _details(s).select("kind", "summary", "n_documents", "confirmed"), """WITH g AS (SELECT s_nationkey AS n, list_sort(list(DISTINCT concat('s', s_suppkey))) AS p, count(DISTINCT s_suppkey % 3) AS d FROM supplier GROUP BY 1 HAVING count(*) > 1) SELECT 'shared_detail' AS kind, concat(array_to_string(p[1:3], ', '), ' share nation n', n) AS summary, d AS n_documents, true AS confirmed FROM g""")


def _bridges(k: DataFrame, e: DataFrame) -> DataFrame:
    edges = k.select(F.col("a").alias("from_page"), F.col("b").alias("to_page"), F.when(F.substring("b", 1, 1) == "s", 1).otherwise(F.length("b") % 2).alias("n_confirmed"), F.array(F.concat_ws("+", "a", "b")).alias("docs"))
    return questions.person_bridges(edges, e.select(F.col("entity_id").alias("node"), "type_id"))


add("bridge_questions", "relations entities", lambda k, e: _bridges(k, e).select("kind", "summary", "n_documents", "confirmed"), """, t AS (SELECT q.b AS person, least(o.a, o.b) AS x, greatest(o.a, o.b) AS y FROM relations o JOIN relations p ON p.a = o.a JOIN relations q ON q.a = o.b AND q.b = p.b WHERE o.b LIKE 's%' AND p.b LIKE 'c%')
 SELECT DISTINCT 'person_bridges' AS kind, concat_ws(' ', person, 'is between', x, 'and', y) AS summary, 3::BIGINT AS n_documents, length(person) % 2 = 1 AS confirmed FROM t""")


def _raised(line: DataFrame, s: DataFrame) -> DataFrame:
    found = [_parts(line), _details(s)]
    told = reduce(DataFrame.unionByName, found)
    said = told.where("NOT confirmed").select("fingerprint", F.lit(1).alias("seq"), F.lit("dismissed").alias("status"), "digest", F.lit("r").alias("rationale"))
    return questions.raised(found, said).groupBy("kind", "status", "confirmed").agg(F.count(F.lit(1)).alias("n"))


add("questions_by_state", "lineitem supplier", _raised, """WITH p AS (SELECT 'two_parts_in_one_document' AS kind, bool_and(l_linestatus = 'F') AS confirmed FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_returnflag) > 1 UNION ALL SELECT 'shared_detail', true FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)
 SELECT kind, CASE WHEN confirmed THEN 'open' ELSE 'dismissed' END AS status, confirmed, count(*) AS n FROM p GROUP BY 1, 2, 3""")
add("ranked_questions", "lineitem", lambda line: questions.ranked(review.judged(_parts(line), _parts(line).where("false").select("fingerprint", F.lit(1).alias("seq"), F.lit("x").alias("status"), "digest", F.lit("r").alias("rationale"))), 20).select("summary", "status", "confirmed"), """SELECT concat(l_suppkey, ' is ', string_agg(DISTINCT l_returnflag, ' and ' ORDER BY l_returnflag), ' of ', l_orderkey) AS summary, 'open' AS status, bool_and(l_linestatus = 'F') AS confirmed FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_returnflag) > 1 ORDER BY confirmed DESC, summary LIMIT 20""")
