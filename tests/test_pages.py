import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lectern.operators import agreement, corpus, entities, extraction, graph, lint, questions, review, search, survey, text


def test_wordings_equal_a_plain_greedy_pass(spark):
    rng = random.Random(31)
    base = ["the supplier shall deliver the goods within thirty days of the order", "payment falls due on the first of each month", ""]
    rows = []
    for k in range(12):
        for d in range(8):
            words = rng.choice(base).split()
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["x", "other", "days,"])
            rows.append((f"k{k}", d, " ".join(words)))
    got = {r["k"]: tuple(r)[1:4] for r in agreement.wordings(spark.createDataFrame(rows, "k string, document_id long, excerpt string"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        heads, sizes = [], []
        for _, d, e in sorted(r for r in rows if r[0] == k):
            e = e.replace(",", "")
            at = next((i for i, h in enumerate(heads) if (not e and not h) or (e and h and SequenceMatcher(None, e, h).ratio() >= 0.92)), None)
            if at is None:
                heads.append(e)
                sizes.append({d})
            else:
                sizes[at].add(d)
        assert got[k] == (8, len(heads), sum(len(s) > 1 for s in sizes))


def test_folded_headers(spark):
    body = "PEP: 12\nTitle: A long\n  title goes on\nStatus:\n\nNote: alone\ntext\nA-b: 1\nC d: 2\n\n  x\n"
    got = [(r["key"], r["value"], r["line"]) for r in text.header_fields(spark.createDataFrame([(1, body)], "document_id long, text string")).orderBy("line").collect()]
    assert got == [("PEP", "12", 0), ("Title", "A long title goes on", 1), ("Status", "", 3)]


def test_bridges_and_shared_counterparties_against_naive(spark):
    rng = random.Random(32)
    nodes = [f"{'p' if i < 6 else 'o'}{i:02}" for i in range(18)]
    links = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(30)})
    df = spark.createDataFrame(links, "a string, b string")
    types = spark.createDataFrame([(n, "Person" if n[0] == "p" else "Company") for n in nodes], "node string, type_id string")
    linked = {frozenset(x) for x in links}
    expected = {(p, a, b) for p in nodes[:6] for a, b in combinations(nodes[6:], 2) if {frozenset((p, a)), frozenset((p, b)), frozenset((a, b))} <= linked}
    got = [tuple(r) for r in graph.person_bridges(df, types).select("person", "a", "b").collect()]
    assert sorted(got) == sorted(expected) and expected
    cuts = graph.cut_vertices(graph.adjacency_of(*(df.toPandas()[c].to_numpy() for c in "ab")))
    near = {n: {x for k in links for x in k if n in k and x != n} for n in nodes}
    pairs = {n: sum(frozenset(p) not in linked for p in combinations(sorted(near[n]), 2)) for n in cuts}
    assert {r["via"]: r["n_pairs"] for r in graph.shared_neighbours(df).collect()} == {k: v for k, v in pairs.items() if v}
    threes = {frozenset(t) for t in combinations(nodes, 3) if all(frozenset(p) in linked for p in combinations(t, 2))}
    found = [frozenset(r) for r in graph.triangles(df).select("x", "y", "z").collect()]
    assert len(found) == len(threes) and set(found) == threes


def test_communities(spark):
    ring = lambda name, n: [(f"{name}{i}", f"{name}{j}") for i, j in combinations(range(n), 2)]
    links = [*ring("a", 5), *ring("b", 5), ("a0", "b0")]
    df = spark.createDataFrame(links, "a string, b string")
    for method in graph.METHODS:
        found = {r["node"]: r["community"] for r in graph.communities(df, method).collect()}
        assert all(len({c for k, c in found.items() if k[0] == clique}) == 1 for clique in "ab"), method
        assert found["a1"] == "a0"
    assert found["b1"] == "b0"  # label propagation may run the two into one
    labels = graph.communities(df, "louvain")
    assert graph.modularity(df, labels).first()["modularity"] == pytest.approx(0.4524, abs=1e-3)
    told = graph.topology(df, spark.createDataFrame([(n, n.upper(), "X") for n in {x for k in links for x in k} | {"z"}], "node string, name string, type_id string"))
    assert {k: v.count() for k, v in told.items()} == {"components": 1, "cut_vertices": 2, "isolates": 1, "degree": 10, "betweenness": 10, "communities": 2, "modularity": 1, "bridges": 2, "connections": 1, "unconnected": 1}
    assert told["components"].first()["label"] == "A0"


def test_label_propagation_settles_on_a_long_path():
    path = {f"n{i:04}": sorted(f"n{j:04}" for j in (i - 1, i + 1) if 0 <= j < 400) for i in range(400)}
    label = graph.propagated(path)
    for node, near in path.items():
        counts = [label[o] for o in near]
        assert counts.count(label[node]) == max(map(counts.count, counts))


def test_merge_chains_of_any_length_and_rings(spark):
    rows = [(f"e{i:03}", f"e{i + 1:03}" if i < 60 else None) for i in range(61)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t", "r2")]
    got = {r["entity_id"]: r["survivor"] for r in entities.follow_merges(spark.createDataFrame(rows, "entity_id string, merged_into string")).collect()}
    assert {got[f"e{i:03}"] for i in range(61)} == {"e060"}
    assert got["r1"] == got["r2"] == got["r3"] == got["t"] == "r1"


def test_candidates_for_mentions(spark):
    pages = spark.createDataFrame([("e1", "C", "Acme Ltd", "9", None), ("e2", "C", "Acmes", None, None), ("e3", "C", "Other", None, None), ("e4", "C", "Acme", None, "e1")], "entity_id string, type_id string, canonical_name string, identifier string, merged_into string")
    mentions = spark.createDataFrame([("m1", "C", "Acme", "9"), ("m2", "C", "ACME plc", None), ("m3", "P", "Acme", "9")], "instance_id string, type_id string, name string, identifier string")
    got = {(r["instance_id"], r["entity_id"]): r["basis"] for r in entities.candidates_for(mentions, pages).collect()}
    assert got == {("m1", "e1"): "identifier", ("m1", "e2"): "similar", ("m2", "e1"): "naive_key"}


def test_events_are_numbered_without_gaps(spark):
    rows = spark.range(500).selectExpr("concat('r', lpad(cast(id AS string), 4, '0')) AS row_id", "'d' AS document_id")
    got = [(r["seq"], r["row_id"]) for r in review.events(rows, "confirm", "ana", "2024-01-01", 100).orderBy("seq").collect()]
    assert got == [(100 + i, f"r{i:04}") for i in range(500)]
    assert review.events(rows.where("false"), "confirm", "ana", "2024-01-01", 0).count() == 0


def test_failing_engines_leave_a_row(spark):
    docs = spark.createDataFrame([(1, "Acme trades."), (2, None)], "document_id long, text string")

    def engine(body: str) -> list[dict]:
        if not body:
            raise RuntimeError("nothing to read")
        return [{"type": "Company", "attributes": {"name": ["Acme", "ACME"]}, "quote": "acme trades", "confidence": 1.0}]

    got = {r["document_id"]: r for r in extraction.populate(docs, engine).collect()}
    assert got[2]["error"] == "RuntimeError: nothing to read" and got[2]["confidence"] is None
    assert got[1]["properties"] == {"name": ["Acme", "ACME"]} and got[1]["alignment"] == "match_exact" and got[1]["char_start"] == 0
    extraction.register_engine("stub", engine)
    assert extraction.resolve_engine("stub") is engine and extraction.resolve_engine() is engine and extraction.engine_names() == ["stub"]
    with pytest.raises(KeyError, match="no engine x"):
        extraction.resolve_engine("x")


def test_lint_runs_what_it_has_tables_for(spark):
    tensions = spark.createDataFrame([("t1", "c1", "p", "open")], "tension_id string, subject_id string, property_id string, status string")
    pages = spark.createDataFrame([("e1", "C", "Acme Ltd", None, "confirmed"), ("e2", "C", "Acme", None, "unconfirmed"), ("e3", "C", "The Buyer", None, "unconfirmed")], "entity_id string, type_id string, canonical_name string, merged_into string, status string")
    mentions = spark.createDataFrame([("i1", "e2", "d1", "unconfirmed", False)], "instance_id string, entity_id string, document_id string, status string, unlinked boolean")
    found = lint.lint({"tensions": tensions, "pages": pages, "mentions": mentions})
    got = {(r["check_name"], r["severity"], r["subject"]) for r in found.collect()}
    assert got == {("unchecked_conflict", "medium", "c1:p"), ("uncited_page", "high", "e1"), ("uncited_page", "medium", "e3"), ("split_page", "medium", "e1:e2"), ("unnamed_page", "medium", "e3")}
    assert lint.headline(found, 5).first()["headline"] == "1 grave findings by 5 of 12 checks"
    assert [r["check_name"] for r in lint.counted(found).collect()][0] == "uncited_page"
    assert lint.headline(found.where("false"), 12).first()["headline"] == "nothing found by all checks"
    assert {r["check_name"] for r in lint.lint({"pages": pages}, deep=False).collect()} == {"unnamed_page"}


def test_judgements_go_stale_with_their_evidence(spark):
    roles = spark.createDataFrame([("d1", "e1", "buyer", "confirmed"), ("d1", "e1", "seller", "confirmed"), ("d2", "e2", "buyer", "x"), ("d2", "e2", "seller", "x")], "document_id string, entity_id string, part string, status string")
    found = questions.two_parts(roles)
    said = found.select("fingerprint", F.lit(1).alias("seq"), F.lit("dismissed").alias("status"), F.when(F.col("confirmed"), F.col("digest")).otherwise("old").alias("digest"), F.lit("").alias("rationale"))
    got = {r["confirmed"]: (r["status"], r["stale"]) for r in questions.raised([found], said).collect()}
    assert got == {True: ("dismissed", False), False: ("open", True)}
    assert questions.raised([found], said, open_only=True).count() == 1


def test_survey_counts_documents_that_really_quote(spark):
    docs = spark.createDataFrame([(1, "Value: 5\nSize: 3\nName: x\nthe price is five"), (2, "Value: 7\nSize: 1\nName: y"), (3, "nothing")], "document_id long, text string")
    offers = spark.createDataFrame([("C", "value", 1, "the price is five"), ("C", "value", 3, "the price is five"), ("C", "value", 3, "the price is not")], "type_id string, property_id string, document_id long, quote string")
    plain = {r["property_id"]: r["support"] for r in survey.corroborated(offers, docs).collect()}
    assert plain == {"value": 1, None: 1}
    wide = {r["property_id"]: r["support"] for r in survey.corroborated(offers, docs, text.header_fields(docs)).collect()}
    assert wide == {"value": 2, None: 2}


def test_search_finds_phrases_and_stems(spark):
    docs = spark.createDataFrame([(1, "The supplier delivers the goods."), (2, "goods the delivering"), (3, "deliver")], "doc_id long, text string")
    ids = lambda q: sorted(r["doc_id"] for r in search.search(docs, q, ["doc_id"]).collect())
    assert ids("delivered") == [1, 2, 3] and ids('"the goods"') == [1] and ids('deliver "the goods"') == [1] and ids("goods delivering") == [1, 2]
    first = search.best(search.search(docs, "delivers goods", ["doc_id"]), ["doc_id"], 1)
    assert "delivering" in search.with_snippets(first, docs, ["doc_id"]).first()["snippet"]


def test_exposed_keys_only(spark):
    rows = spark.createDataFrame([('{"a b": "1"}', "accepted"), ('{"a b": "1"}', "staged")], "values_json string, status string")
    assert corpus.register_rows(rows, "a b", "1", ["a b"], "accepted").count() == 1
    with pytest.raises(ValueError, match="not exposed"):
        corpus.register_rows(rows, "c", "1", ["a b"])
    assert corpus.exposed(rows, ["a b"]).columns[-1] == "x_a_b"
