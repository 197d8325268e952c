import random

import pytest

from lectern.operators import agreement, pages

CLAIMS, MENTIONS, BEARING = "entity_id string, property_id string, value string", "entity_id string, document_id long", "entity_id string, register_id string, identifier string"


def test_evidence_of_pairs_equals_a_plain_count(spark):
    rng = random.Random(4)
    ids = [f"p{i}" for i in range(12)]
    claims = [(rng.choice(ids), rng.choice(["vat", "city", "street"]), rng.choice(["x", "y", "z", "", None])) for _ in range(150)]
    mentions = [(rng.choice(ids), rng.choice([1, 2, 3, None])) for _ in range(60)]
    bearing = [(rng.choice(ids), rng.choice(["r1", "r2", None]), rng.choice(["7", "8", "9", "", None])) for _ in range(60)]
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(30)] + [("p1", "p1"), ("nobody", "p2")]
    got = pages.evidence_of_pairs(*(spark.createDataFrame(r, s) for r, s in [(pairs, "a string, b string"), (claims, CLAIMS), (mentions, MENTIONS), (bearing, BEARING)]), ["vat"]).collect()
    stated = {c for c in claims if c[2]}
    want = {}
    for a, b in {p for p in pairs if p[0] != p[1]}:
        both = {(p, v) for e, p, v in stated if e == a} & {(p, v) for e, p, v in stated if e == b}
        share = [len({e for e, *x in stated if tuple(x) == pv}) / len({e for e, p, _ in stated if p == pv[0]}) for pv in both]
        documents = {d for e, d in mentions if e == a and d} & {d for e, d in mentions if e == b and d}
        numbers = [{r: {n for e, s, n in bearing if e == x and s == r and n} for r in ("r1", "r2")} for x in (a, b)]
        told = [bool(numbers[0][r] & numbers[1][r]) for r in ("r1", "r2") if numbers[0][r] and numbers[1][r]]
        want[a, b] = (sum(p == "vat" for p, _ in both), sum(p != "vat" for p, _ in both), len(documents), sum(told), len(told) - sum(told), min(share, default=None))
    assert len(got) == len(want)
    assert {tuple(r)[:2]: tuple(r)[2:8] for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_verdict_holds_until_the_evidence_moves(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    mentions, bearing = spark.createDataFrame([], MENTIONS), spark.createDataFrame([], BEARING)
    claims = [("a", "vat", "1"), ("b", "vat", "1")]
    evidence = lambda more: pages.evidence_of_pairs(pairs, spark.createDataFrame(claims + more, CLAIMS), mentions, bearing, ["vat"])
    first = {(r["a"], r["b"]): r["digest"] for r in evidence([]).collect()}
    said = spark.createDataFrame([(1, "b", "a", "same", "other", "r"), (2, "b", "a", "distinct", first["a", "b"], "r")], "seq long, a string, b string, status string, digest string, rationale string")
    verdicts = lambda more: [tuple(r) for r in pages.pair_verdicts(evidence(more), said).collect()]
    assert verdicts([]) == [("a", "b", "distinct", False)]
    # Another page with the value makes it less rare, but changes nothing between the two.
    assert verdicts([("z", "vat", "1")]) == [("a", "b", "distinct", False)]
    assert verdicts([("a", "city", "x"), ("b", "city", "x")]) == [("a", "b", "open", True)]
    assert verdicts([("a", "vat", "1"), ("b", "vat", None)]) == [("a", "b", "distinct", False)]


def test_statements_are_worked_out_once(spark):
    """relations of several documents are counted and worded from one reading of what makes the statements."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    schema = "from_page string, link_type_id string, to_page string, document_id string, excerpt string"
    rows = [("a", "x", "b", "d1", "said so"), ("a", "x", "b", "d2", "quite other words"), ("a", "x", "c", "d1", "said so")]
    told = agreement.corroborated_relations(spark.createDataFrame(rows, schema).mapInPandas(run, schema)).collect()
    assert [(r["to_page"], r["n_documents"], r["n_wordings"]) for r in told] == [("b", 2, 2)]
    assert read.value == len(rows)
