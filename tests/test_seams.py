import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import registered, scalar
from lectern.operators import corpus, gate
from lectern.sources import adapters


def test_functions_in_sql(spark):
    assert registered.register(spark) == ["align", "find_values", "name_key", "property_id", "snap_confidence"]
    names = ["The Acme Co Ltd.", "Prof. Dr. Ána Núñez", "Ltd", "", "Dr"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for style in ("organisation", "personal"):
        got = rows.select(F.expr(f"name_key(n, '{style}')").alias("a"), scalar.name_key(F.col("n"), style).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    assert [tuple(r) for r in spark.sql("SELECT snap_confidence(0.69999999999), snap_confidence(NULL), property_id('Created On!'), property_id('!')").collect()] == [(0.7, 0.5, "created_on", "field")]
    assert spark.sql("SELECT align('The “Supplier” pays', '\"supplier\"').status").first()[0] == "match_exact"
    found = spark.sql("SELECT v.* FROM (SELECT 'Signed 2024-01-01 for EUR 10' AS t) d, LATERAL find_values(d.t) v").collect()
    assert [(r["kind"], r["value"], r["role"]) for r in found] == [("date", "2024-01-01", "signature"), ("amount", "10", "unknown")]


def test_tolerant_json_and_guards(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("",), (None,), ("{broken",)], "t string")
    got = [r[0] for r in rows.select(registered.from_json_or(F.col("t"), "map<string,string>", F.create_map().cast("map<string,string>"))).collect()]
    assert got[0] == {"a": "1"} and got[1] == got[2] == {}
    assert spark.createDataFrame([("x",)], "t string").select(registered.required(F.col("t"), ["x", "y"])).first()[0] == "x"
    with pytest.raises(Exception, match="may not be z"):
        spark.createDataFrame([("z",)], "t string").select(registered.required(F.col("t"), ["x", "y"])).collect()


def test_register_adapter(spark):
    payload = {"data": [{"attributes": {"lei": "L1", "entity": {"legalName": {"name": "Acme"}, "registeredAs": "7"}}}, {"attributes": {"lei": None, "entity": {"legalName": {"name": "None"}}}}]}
    adapters.register_adapter("saved", lambda name, limit: json.dumps(payload) if name == "acme" else "{}")
    assert adapters.adapters() == ["saved"]
    got = [(r["asked"], r["name"], r["identifier"]) for r in adapters.fetch(spark, "saved", ["acme", "other"]).collect()]
    assert got == [("acme", "Acme", "7")]


def test_gate(spark):
    calls = spark.createDataFrame([("cloud", 60, "2024-01-05 00:00:00", "x"), ("cloud", 30, "2023-12-31 00:00:00", None), ("local", 500, "2024-01-06 00:00:00", None)], "tier string, prompt_chars long, t string, error string").selectExpr("tier", "prompt_chars", "cast(t AS timestamp) AS called_at", "error", "1 AS document_id")
    policy = gate.Policy("always", budget_chars=100)
    gate.assert_allowed(calls, policy, False, "2024-01-10", 40)
    with pytest.raises(gate.Refused, match="60 of 100"):
        gate.assert_allowed(calls, policy, False, "2024-01-10", 41)
    with pytest.raises(gate.Refused, match="consented"):
        gate.assert_allowed(calls, gate.Policy(), False, "2024-01-10")
    with pytest.raises(gate.Refused, match="policy"):
        gate.assert_allowed(calls, gate.Policy("never"), True, "2024-01-10")
    assert gate.spent(calls, gate.Policy(window="total"), "2024-01-10").first()["chars"] == 90


def test_corpus_analysis(spark):
    instances = spark.createDataFrame([("i1", 1, "Company", "Acme", "acme", "9"), ("i2", 2, "Company", "ACME Ltd", "acme", "9"), ("i3", 3, "Person", "Acme", "acme", None), ("i4", 4, "Company", "Lone", "lone", None)], "instance_id string, document_id long, type_id string, name string, name_key string, identifier string")
    mentions = spark.createDataFrame([], "instance_id string, entity_id string, status string, unlinked boolean")
    contracts = spark.createDataFrame([(1, "acme", "EUR", 10.0), (2, "acme", "EUR", 20.0), (3, "acme", None, 5.0)], "document_id long, counterparty string, currency string, value double")
    told = corpus.corpus_analysis(instances, mentions, contracts, ["Company", "Person"])
    assert sorted((r["instance_id"], r["n_documents"], r["n_cross_type"], r["n_other_names"]) for r in told["matches_Company"].collect()) == [("i1", 1, 1, 1), ("i2", 1, 1, 1)]
    assert [(r["instance_id"], r["n_documents"], r["n_cross_type"]) for r in told["matches_Person"].collect()] == [("i3", 0, 2)]
    assert [tuple(r) for r in told["identifiers"].collect()] == [("9", 2, 2)]
    assert sorted((r["document_id"], r["ratio"]) for r in told["values"].collect()) == [(1, 0.5), (2, 2.0)]
    assert told["quality"].first()[0] == "naive_unresolved"
    docs = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, redacted_at string")
    assert [r["doc_id"] for r in corpus.redacted(docs).collect()] == [2]
    row, pages = corpus.document(docs, spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "doc_id long, page_no int"), 1)
    assert row.count() == 1 and [r["page_no"] for r in pages.collect()] == [1, 2]
