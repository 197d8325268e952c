"""Runs of an engine, and what decisions leave: edges, offers, registers."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import extraction, review, runs, text
from lectern.plans import review_queries
from lectern.sources.store import Store

TEXTS = {
    1: "This Agreement commences on 2024-05-01 for customer 7. The total value is 250,000 EUR.",
    2: "This Agreement commences on 2024-02-01 for customer 8. The total value is 9,000 EUR.",
    3: "For customer 9 nothing is dated and 2-02 is none.",
    4: "  ",
    5: None,
}


def failing(text):
    if "-02" in text:
        raise TimeoutError("no answer")
    return review_queries._stub(text) if "customer" in text else []


def state(df):
    return {r["document_id"]: (r["status"], r["n_deterministic"], r["n_found"], r["n_superseded"]) for r in df.collect()}


def test_runs_end_and_are_repeated_as_they_should(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    documents = spark.createDataFrame([*TEXTS.items()], "document_id long, text string")
    first = state(runs.run(store, documents, "r1", "local", failing, "stub"))
    # Patterns stay where the engine fails; with neither there is nothing; without text there is no run.
    assert first == {1: ("complete", 2, 2, 0), 2: ("partial", 2, 0, 0), 3: ("failed", 0, 0, 0), 4: ("failed", 0, 0, 0), 5: ("failed", 0, 0, 0)}
    assert {r["document_id"]: r["error"] for r in store.table("runs").collect()} == {1: None, 2: "TimeoutError: no answer", 3: "TimeoutError: no answer", 4: "no text to extract from", 5: "no text to extract from"}
    assert store.table("findings").groupBy("document_id").count().count() == 2
    version = store.version()
    # Only what is due runs again, and what the patterns found already is not found twice.
    second = state(runs.run(store, documents.where("document_id < 4"), "r2", "local", review_queries._stub, "stub"))
    assert second == {2: ("complete", 0, 2, 0), 3: ("complete", 0, 2, 0)}
    assert runs.run(store, documents.where("document_id < 4"), "r3", "local", failing, "stub").count() == 0
    assert store.version() == version + 1
    held = lambda: {(r["document_id"], r["source"], r["status"]): r["n"] for r in store.table("findings").groupBy("document_id", "source", "status").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert held() == {(1, "deterministic", "unconfirmed"): 2, (1, "ai_local", "unconfirmed"): 2, (2, "deterministic", "unconfirmed"): 2, (2, "ai_local", "unconfirmed"): 2, (3, "ai_local", "unconfirmed"): 2}
    # A forced run supersedes what nobody has reviewed.
    store.transaction({"findings": store.table("findings").selectExpr("* EXCEPT (status)", "CASE WHEN document_id = 1 AND local_id = '0' AND source = 'ai_local' THEN 'confirmed' ELSE status END AS status")})
    third = state(runs.run(store, documents.where("document_id = 1"), "r4", "local", review_queries._stub, "stub", force=True))
    assert third == {1: ("complete", 0, 2, 1)}
    assert held()[1, "ai_local", "rejected"] == 1 and held()[1, "ai_local", "confirmed"] == 1 and held()[1, "ai_local", "unconfirmed"] == 2
    # Another tier is another run, and has no patterns.
    assert state(runs.run(store, documents.where("document_id = 1"), "r5", "cloud", failing, "stub")) == {1: ("complete", 0, 2, 0)}


def test_another_populator(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    documents = spark.createDataFrame([(1, "some text")], "document_id long, text string")
    made = []

    def populator(due, engine):
        made.append(due.count())
        return runs.populate(due, lambda text: [{"type_id": "Clause", "properties": {"text": "some"}, "quote": "some"}])

    assert state(runs.run(store, documents, "r1", "local", None, "own", populator=populator)) == {1: ("complete", 0, 1, 0)}
    assert made == [1]


LOG = "seq long, table_name string, row_id string, document_id string, action string, new_value string, edited_by string, edited_at timestamp"


def log(spark, *rows):
    return spark.createDataFrame([(i, t, r, d, a, v and (v if isinstance(v, str) else json.dumps(v)), "ana", None) for i, (t, r, d, a, v) in enumerate(rows)], LOG)


def test_edges(spark):
    edges = spark.createDataFrame([(e, "unconfirmed", "owns", "ai_local") for e in "abcd"], "edge_id string, status string, link_type_id string, source string")
    told = review.edge_states(edges, log(spark, ("edges", "a", "1", "edge_confirmed", {"status": "confirmed"}), ("edges", "b", "1", "edge_confirmed", {"link_type_id": "holds"}), ("edges", "c", "1", "edge_confirmed", {"link_type_id": "holds"}), ("edges", "c", "1", "edge_rejected", None)))
    assert {tuple(r) for r in told.collect()} == {("a", "confirmed", "owns", "ai_local", 1), ("b", "amended", "holds", "human", 1), ("c", "rejected", "holds", "human", 2), ("d", "unconfirmed", "owns", "ai_local", 0)}


def test_offers(spark):
    offered = spark.createDataFrame([(s, "d", 1, t, {"name": "Acme", "x": "1"}, "quote", "e", 0.7) for s, t in (("s1", "Company"), ("s2", "Company"), ("s3", "Company"), ("s4", "Riddle"), ("s5", "Company"))], "suggestion_id string, document_id string, page_no int, type_id string, properties map<string,string>, quote string, engine string, confidence double")
    decided = log(spark, ("suggestions", "s1", "d", "accept_suggestion", {"name": "Acme Ltd", "x": "1"}), ("suggestions", "s2", "d", "dismiss_suggestion", None), ("suggestions", "s2", "d", "accept_suggestion", None), ("suggestions", "s4", "d", "accept_suggestion", None), ("suggestions", "s5", "d", "accept_suggestion", None))
    settled = review.settled_offers(offered, decided)
    assert {r["suggestion_id"]: (r["status"], r["instance_id"] is not None) for r in settled.collect()} == {"s1": ("accepted", True), "s2": ("dismissed", False), "s3": ("offered", False), "s4": ("accepted", True), "s5": ("accepted", True)}
    rows, strays = review.accepted_instances(settled, {"Company": ["name"]})
    assert {r["suggestion_id"]: (r["properties"], r["corrected"], r["source"], r["status"], r["source_label"]) for r in rows.collect()} == {"s1": ({"name": "Acme Ltd"}, ["name"], "human", "confirmed", "companion:e"), "s5": ({"name": "Acme"}, [], "human", "confirmed", "companion:e")}
    assert [tuple(r) for r in strays.collect()] == [("s4", "Riddle")]


@pytest.mark.parametrize(("events", "register", "row"), [
    ([], "staged", "staged"),
    (["promote"], "active", "accepted"),
    (["rejected", "promote"], "active", "rejected"),
    (["promote", "staged"], "active", "staged"),
    (["promote", "staged", "promote"], "active", "staged"),
    (["promote", "staged", "withdraw", "promote"], "active", "accepted"),
    (["promote", "withdraw"], "withdrawn", "accepted"),
    (["accepted"], "staged", "accepted"),
])
def test_registers(spark, events, register, row):
    told = [("registers", "r", None, e, None) if e in ("promote", "withdraw") else ("register_rows", "r:1", None, "review", {"status": e}) for e in events]
    own = log(spark, *told)
    states = review.register_states(spark.createDataFrame([("r",)], "register_id string"), own)
    assert states.first()["status"] == register
    assert review.register_row_states(spark.createDataFrame([("r", 1)], "register_id string, row_no int"), states, own).first()["status"] == row


def test_plain_texts_are_not_read_letter_by_letter(monkeypatch):
    """most quotations stand in plain ASCII; what is not found there costs no look at each character."""
    for told in ("", " ", "  A\t b\n\n C ", "a\x1cb\x1f\x1f", "No gap", "Zwei  Ⅻ ﬁn", "\n\nx", "A" * 5):
        assert text.flat(told) == text.flattened(told)[0]
    assert text.align("The  Fee\nis due", "the fee is") == (0, 11, "match_greater")
    monkeypatch.setattr(text, "flattened", None)
    assert text.align("This Agreement  is made", "Zebras waive all warranties") == (None, None, None)


def test_patterns_need_no_shuffle(spark):
    """pages tell where they begin, so that what is found on them does not have to meet their offsets."""
    docs = spark.createDataFrame([(1, "Signed 2020-01-02\fand £5 on\f2021-03-04"), (2, None), (3, "")], "doc_id long, text string")
    none = docs.select("doc_id", F.lit(1).alias("page_no"), F.lit("").alias("raw")).where("false")
    told, plain = (extraction.deterministic_pass(text.pages_of(docs, starts=s), none) for s in (True, False))
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["raw"], r["page_no"], r["char_start"], r["char_end"]) for r in told.collect())
    assert rows == sorted((r["raw"], r["page_no"], r["char_start"], r["char_end"]) for r in plain.collect())
    assert rows == [("2020-01-02", 1, 7, 17), ("2021-03-04", 3, 26, 36), ("£5", 2, 21, 23)]
