"""The document model over the driver's star-schema tables, as SQL that more than one engine reads.

Braces name other views or tables. ``view`` builds one with Spark; ``ctes`` writes the same
definitions as common table expressions for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()

SNAP = "CASE WHEN {0} >= 1 - 1e-9 THEN 1.0e0 WHEN {0} >= 0.9e0 - 1e-9 THEN 0.9e0 WHEN {0} >= 0.7e0 - 1e-9 THEN 0.7e0 WHEN {0} >= 0.5e0 - 1e-9 THEN 0.5e0 ELSE 0.2e0 END"

VIEWS = {
    # One extracted finding for each line: its claim (confidence, source, quotation) and its review.
    "findings": f"""SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS instance_id, concat('doc_', l_orderkey) AS document_id,
        CASE WHEN l_linenumber % 3 = 0 THEN 'Company' WHEN l_linenumber % 3 = 1 THEN 'Clause' ELSE 'KeyDate' END AS type_id,
        {SNAP.format('(1e0 - 5e0 * l_discount)')} AS confidence, CASE WHEN l_linestatus = 'O' THEN 'ai_cloud' ELSE 'ai_local' END AS source,
        CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_returnflag = 'N' THEN 'unconfirmed' WHEN l_linenumber % 4 = 0 THEN 'amended' ELSE 'confirmed' END AS status,
        CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'match_fuzzy' ELSE 'match_exact' END AS alignment,
        CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat('part ', l_partkey) END AS excerpt,
        concat('rule_', l_suppkey % 12) AS concept_id, l_orderkey, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_shipdate AS DATE) AS shipdate FROM {{lineitem}}""",
    # Pages of suppliers and customers; some were merged into their neighbour.
    "entities": """SELECT concat('s', s_suppkey) AS entity_id, 'Company' AS type_id, concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ' Ltd' WHEN s_suppkey % 3 = 1 THEN ' Limited' ELSE ' plc' END) AS canonical_name,
        CASE WHEN s_suppkey % 10 = 0 THEN concat('s', s_suppkey - 1) END AS merged_into FROM {supplier}
        UNION ALL SELECT concat('c', c_custkey), 'Person', concat(CASE WHEN c_custkey % 2 = 0 THEN 'Dr ' ELSE '' END, c_name), CAST(NULL AS VARCHAR(20)) FROM {customer}""",
    "mentions": """SELECT DISTINCT concat('S', l_orderkey, '-', l_suppkey) AS instance_id, concat('s', l_suppkey) AS entity_id, concat('doc_', l_orderkey) AS document_id,
        CASE WHEN l_orderkey % 3 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status, l_orderkey % 17 = 0 AS unlinked FROM {lineitem}
        UNION ALL SELECT concat('C', o_orderkey), concat('c', o_custkey), concat('doc_', o_orderkey), CASE WHEN o_orderkey % 4 = 0 THEN 'amended' ELSE 'unconfirmed' END, o_orderkey % 19 = 0 FROM {orders}""",
    "edges": f"""SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS edge_id, concat('S', l_orderkey, '-', l_suppkey) AS from_instance_id, concat('C', o_orderkey) AS to_instance_id,
        l_returnflag AS link_type_id, concat('doc_', o_orderkey) AS document_id, CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'rejected' WHEN l_linenumber % 3 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status,
        {SNAP.format('(1e0 - 5e0 * l_discount)')} AS confidence FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    # An undirected graph for structure: customers and suppliers that meet in an order.
    "links": """SELECT DISTINCT concat('s', l_suppkey) AS a, concat('c', o_custkey) AS b FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # A graph with links among companies too: neighbours by number trade with each other.
    "relations": """SELECT a, b FROM {links} UNION ALL SELECT concat('s', s_suppkey) AS a, concat('s', s_suppkey + 1) AS b FROM {supplier} WHERE s_suppkey < (SELECT max(s_suppkey) FROM {supplier})""",
    # A graph that falls apart at single nodes: clients with the client they were merged into, and retail clients with their nation.
    "kin": """SELECT concat('c', client_id) AS a, concat('c', master_id) AS b FROM {clients} WHERE client_id <> master_id
        UNION SELECT concat('c', client_id) AS a, concat('n', nation_id) AS b FROM {clients} WHERE nation_id IS NOT NULL AND segment = 'retail'""",
    # Conflicts on record, and rule evaluations, of which some were outdated by a later date.
    "tensions": """SELECT concat('t', c_custkey) AS tension_id, concat('c', c_custkey) AS subject_id, 'priority' AS property_id, CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'accepted' WHEN 2 THEN 'withdrawn' ELSE 'resolved' END AS status FROM {customer} WHERE c_acctbal < 2000""",
    "evaluations": """SELECT instance_id AS evaluation_id, instance_id, document_id, concept_id, quantity >= 40 AS result, shipdate > DATE '2000-01-01' AS stale FROM {findings}""",
    # What people did to each finding, as events: read, then confirmed, amended or rejected a month later.
    "reviews": """SELECT 1000 * l_orderkey + 10 * l_linenumber AS seq, instance_id AS row_id, document_id, 'extract' AS action, CAST(NULL AS VARCHAR(40)) AS new_value, CAST(shipdate AS TIMESTAMP) AS edited_at FROM {findings_lines}
        UNION ALL SELECT 1000 * l_orderkey + 10 * l_linenumber + 1, instance_id, document_id, CASE status WHEN 'rejected' THEN 'reject' WHEN 'amended' THEN 'amend' ELSE 'confirm' END,
        CASE WHEN status = 'amended' THEN concat('{{"quantity":"', quantity + 1, '"}}') END, CAST(shipdate + INTERVAL 30 DAY AS TIMESTAMP) FROM {findings_lines} WHERE status <> 'unconfirmed'""",
    "findings_lines": """SELECT f.*, l_linenumber FROM {findings} f JOIN (SELECT DISTINCT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS i, l_linenumber FROM {lineitem}) n ON f.instance_id = n.i""",
    "link_events": """SELECT 3 * o_orderkey AS seq, concat('C', o_orderkey) AS row_id, 'link' AS action, concat('c', o_custkey) AS new_value FROM {orders}
        UNION ALL SELECT 3 * o_orderkey + 1, concat('C', o_orderkey), 'confirm_link', CAST(NULL AS VARCHAR(20)) FROM {orders} WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 3 * o_orderkey + 2, concat('C', o_orderkey), 'unlink', CAST(NULL AS VARCHAR(20)) FROM {orders} WHERE o_orderstatus = 'P'""",
    "page_events": """SELECT 3 * s_suppkey AS seq, concat('s', s_suppkey) AS row_id, 'create' AS action, s_name AS new_value FROM {supplier}
        UNION ALL SELECT 3 * s_suppkey + 1, concat('s', s_suppkey), 'rename', concat('The ', s_name, ' Ltd.') FROM {supplier} WHERE s_acctbal < 3000
        UNION ALL SELECT 3 * s_suppkey + 2, concat('s', s_suppkey), CASE WHEN s_acctbal < 5000 THEN 'reject' ELSE 'confirm' END, CAST(NULL AS VARCHAR(20)) FROM {supplier} WHERE s_acctbal > 2000""",
    "log": """SELECT event_id AS seq, user_id AS row_id, CAST(ts AS TIMESTAMP) AS edited_at, props AS new_value, value,
        CASE event_type WHEN 'view' THEN 'extract' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'confirm' WHEN 'click' THEN 'amend' ELSE 'reject' END AS action FROM {events}""",
    "key_dates": """SELECT concat('doc_', o_orderkey) AS document_id, 'start' AS date_role, CAST(o_orderdate AS DATE) AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM {orders} WHERE o_orderkey % 6 <> 0
        UNION ALL SELECT concat('doc_', l_orderkey), CASE WHEN l_linenumber % 3 = 0 THEN 'renewal' WHEN l_linenumber % 3 = 1 THEN 'end' ELSE 'milestone' END, CAST(l_shipdate AS DATE), CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'rejected' ELSE 'unconfirmed' END FROM {lineitem}""",
    # Values that pages assert, one row for each mention and property.
    "claims": """SELECT concat('c', o_custkey) AS entity_id, concat('C', o_orderkey) AS instance_id, concat('doc_', o_orderkey) AS document_id, 'priority' AS property_id, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS value,
        o_orderkey % 3 <> 0 AS reviewed, o_orderstatus = 'P' AS rejected, concat('says ', o_orderpriority, ' ', o_orderstatus) AS excerpt FROM {orders}
        UNION ALL SELECT concat('c', o_custkey), concat('C', o_orderkey), concat('doc_', o_orderkey), 'state', o_orderstatus, o_orderkey % 3 <> 0, false, concat('state ', o_orderstatus) FROM {orders}""",
    # Short contracts and header blocks, written from the orders they speak of.
    "contracts": """SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS begun, CAST(round(o_totalprice) AS BIGINT) AS amount,
        concat('This Agreement commences on ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), ' for customer ', o_custkey, '. The total value is ', CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR(20)), ' EUR.') AS text,
        concat('Order: ', o_orderkey, chr(10), 'Status: ', o_orderstatus, chr(10), 'Priority: ', o_orderpriority, chr(10), chr(10), 'Body text') AS header FROM {orders}""",
}


def needs(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])


def needed(names: list[str]) -> list[str]:
    """These views and those that they are made of, each after what it needs."""
    out: list[str] = []
    for name in names:
        out += [n for n in [*needed([m for m in needs(name) if m in VIEWS]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs(name)})


def ctes(*names: str) -> str:
    """WITH ... for the named views; more expressions may follow after a comma."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in needs(n)})})" for n in names)
