import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.operators import bundle, corpus, entities, graph, history, likeness, quality, text
from lectern.streaming import log as stream


def key(spark, name, style="organisation"):
    return spark.createDataFrame([(name,)], "n string").select(scalar.name_key(F.col("n"), style)).first()[0]


def test_name_keys(spark):
    assert key(spark, "The Acme Holdings Ltd.") == "acme holdings"
    assert key(spark, "Acme Co Ltd") == "acme"
    assert key(spark, "Ernst & Young") != key(spark, "Ernst and Young")
    assert key(spark, "Ltd") == "ltd"
    assert key(spark, "Prof. Dr. Ána Núñez", "personal") == "ána núñez"
    assert key(spark, "Dr", "personal") == "dr"
    assert key(spark, "Acme Pty Ltd") == "acme" and key(spark, "Nord Oy Ab") == "nord"
    assert key(spark, "Co Ltd") == "co" and key(spark, "Prof Dr", "personal") == "dr"
    assert key(spark, "Rev. Capt. Jane Roe", "personal") == "jane roe"
    assert key(spark, "Costa Coffee") == "costa coffee" and key(spark, "Theatre Royal") == "theatre royal"
    assert key(spark, "") == ""


def test_snap(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.69999999999,), (0.6,), (2.0,)], "x double")
    assert [r[0] for r in rows.select(scalar.snap_confidence(F.col("x"))).collect()] == [0.5, 0.5, 0.2, 0.7, 0.5, 1.0]


def test_dates_and_amounts():
    found = {f["raw"]: f for f in text.find_dates("Effective 2024-02-30 or 3rd March 2024; expires 01/02/2025, signed December 25, 2023.")}
    assert {r: f["value"] for r, f in found.items()} == {"3rd March 2024": "2024-03-03", "01/02/2025": "2025-02-01", "December 25, 2023": "2023-12-25"}
    assert found["01/02/2025"]["confidence"] == 0.5 and found["01/02/2025"]["role"] == "end"
    money = {f["raw"]: (f["currency"], f["value"], f["confidence"]) for f in text.find_amounts("€2,400,000 and £99.50 and EUR 250000 and 2,400 EUR and 50 euros")}
    assert money["€2,400,000"] == ("EUR", "2400000", 1.0) and money["£99.50"] == ("GBP", "99.5", 1.0)
    assert money["EUR 250"] == ("EUR", "250", 1.0) and money["50 euros"] == ("EUR", "50", 0.9)
    whole = {f["raw"]: f["value"] for f in text.find_amounts("EUR 250000 and $1,500 and £1234.5", whole=True)}
    assert whole == {"EUR 250000": "250000", "$1,500": "1500", "£1234.5": "1234.5"}
    assert [f["value"] for f in text.find_dates("Sept 3, 2024 and 3 Sept. 2024")] == ["2024-09-03", "2024-09-03"]
    assert [f["currency"] for f in text.find_amounts("50 dollar and 5 pound and 1 Euro")] == ["USD", "GBP", "EUR"]
    assert [f["role"] for f in text.find_dates("It runs until 2027-01-01.")] == ["end"]
    terms = "The total contract value is EUR 1,000,000. Aggregate liability shall not exceed EUR 250,000. The day rate is EUR 800."
    assert [f["role"] for f in text.find_amounts(terms)] == ["contract_value", "cap", "rate"]
    both = {f["value"]: f["role"] for f in text.find_dates("Commencing on 1 January 2024 and shall expire on 2026-12-31.")}
    assert both == {"2024-01-01": "start", "2026-12-31": "end"}
    assert text.find_dates("Reference 3 April 2027 appears here.")[0]["role"] == "unknown"


def test_align():
    body = "The “Supplier” shall  deliver the goods without delay and at its own cost."
    assert text.align(body, "shall  deliver")[2] == "match_exact"
    a, b, status = text.align(body, '"supplier" shall deliver')
    assert body[a:b] == "“Supplier” shall  deliver" and status == "match_greater"
    assert text.align(body, '"supplier"')[2] == "match_exact"  # other signs, as long
    assert text.align(body, "deliver the goods without fail")[2] == "match_fuzzy"
    assert text.align(body, "nothing like it") == (None, None, None)


def test_paginate_is_lossless():
    rng = random.Random(1)
    for _ in range(50):
        body = "".join(rng.choice(["word ", "x", "\n", "\n\n", "longer sentence. "]) for _ in range(rng.randint(0, 400)))
        pages = text.paginate(body, 100)
        assert "".join(pages) == body
        assert all(len(p) <= 100 or not p.strip().count(" ") for p in pages)


def test_pages_of_form_feeds_and_blank_lines():
    assert text.split_pages("a\fb\f") == ["a", "b"] and text.split_pages("a\f\f") == ["a", ""] and text.split_pages("") == [""] and text.split_pages("\f") == [""]
    assert text.paginate("aa\n \nbbbb\n\ncc", 6) == ["aa\n \n", "bbbb\n\n", "cc"]
    assert text.paginate("x" * 30, 10) == ["x" * 30]


@pytest.mark.parametrize("small", [200_000, 0])
def test_graph_against_naive(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(2)
    links = sorted({tuple(sorted(rng.sample([f"n{i:02}" for i in range(24)], 2))) for _ in range(26)})
    adjacency = {}
    for a, b in links:
        adjacency.setdefault(a, []).append(b)
        adjacency.setdefault(b, []).append(a)
    adjacency = {k: sorted(v) for k, v in sorted(adjacency.items())}

    def reach(start, without=None):
        seen, todo = {start}, [start]
        while todo:
            for w in adjacency[todo.pop()]:
                if w not in seen and w != without:
                    seen.add(w)
                    todo.append(w)
        return seen

    naive = {n for n in adjacency if len(adjacency[n]) > 1 and reach(adjacency[n][0], n) | {n} != reach(n)}
    assert graph.cut_vertices(adjacency) == naive
    df = spark.createDataFrame(links, "a string, b string")
    assert {r["node"] for r in graph.articulation_points(df).collect()} == naive
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {n: min(reach(n)) for n in adjacency}

    def paths(a, b):
        found, layer = [], [[a]]
        while layer and not found:
            found = [p for p in layer if p[-1] == b]
            layer = [[*p, w] for p in layer for w in adjacency[p[-1]] if w not in p]
        return found

    share = dict.fromkeys(adjacency, 0.0)
    for a, b in combinations(adjacency, 2):
        found = paths(a, b) if b in reach(a) else []
        shortest = [p for p in found if len(p) == min(map(len, found))]
        for p in shortest:
            for n in p[1:-1]:
                share[n] += 1 / len(shortest)
    n = len(adjacency)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    assert got == pytest.approx({k: 2 * v / ((n - 1) * (n - 2)) for k, v in share.items()}, abs=1e-6)


def test_links_hold_every_order(spark):
    from lectern.sources.views import view

    sf = "/root/testdata/sf0.001"
    line, orders = (spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("lineitem", "orders"))
    customer = dict(zip(orders["o_orderkey"], orders["o_custkey"], strict=True))
    expected = {(f"s{s}", f"c{customer[o]}") for s, o in zip(line["l_suppkey"], line["l_orderkey"], strict=True) if o in customer}
    assert {tuple(r) for r in view(spark, sf, "links").collect()} == expected


def test_paths_of_up_to_six_hops(spark):
    rng = random.Random(5)
    links = sorted({tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(18)})
    df = spark.createDataFrame(links, "a string, b string")
    near = {n: {x for k in links for x in k if n in k and x != n} for n in "abcdefghij"}
    found, layer = set(), ["a"]
    for _ in range(6):
        layer = [p + w for p in layer for w in near[p[-1]] if w not in p]
        found |= {p for p in layer if p[-1] == "b"}
        layer = [p for p in layer if p[-1] != "b"]
    assert max(map(len, found)) == 7
    got = [(r["path"], r["length"]) for r in graph.paths_between(df, "a", "b").collect()]
    assert sorted(got) == sorted((">".join(p), len(p) - 1) for p in found)


def test_cycles_of_two_to_four(spark):
    rng = random.Random(8)
    edges = {tuple(rng.sample(range(12), 2)) for _ in range(45)} | {(3, 3)}
    found = {}
    for k in (2, 3, 4):
        for p in permutations(range(12), k):
            if all(e in edges for e in zip(p, p[1:] + p[:1], strict=True)):
                found.setdefault(tuple(sorted(p)), p)
    assert {len(k) for k in found} == {2, 3, 4}
    got = [(r["nodes"], r["path"], r["length"]) for r in graph.cycles(spark.createDataFrame(sorted(edges), "a long, b long")).collect()]
    assert sorted(got) == sorted((",".join(map(str, k)), ">".join(map(str, p)), len(p)) for k, p in found.items())


def test_indel_ratio():
    def naive(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return 200 * row[-1] / (len(a) + len(b))

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 20))) for _ in range(2))
        assert likeness.indel_ratio(a, b) == pytest.approx(naive(a, b))


def test_similar_pages_are_all_found(spark):
    rng = random.Random(6)
    names = ["Smith Holdings", "Smith Holding", "Johnson", "Jonson", "Foo Co Ltd", "Foo", "Foo Limited", "", "!", "ab", "abc", "b a", "a b", *["Same Name"] * 55]
    names += [f"Smith {''.join(rng.choice('xyz') for _ in range(5))}" for _ in range(60)]
    names += ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    rows = [(f"e{i:03}", "XY"[i % 17 == 0], n, None) for i, n in enumerate(names)] + [("gone", "X", "Johnson", "e002")]
    pages = spark.createDataFrame(rows, "entity_id string, type_id string, canonical_name string, merged_into string")
    keyed = pages.select("*", scalar.name_key(F.col("canonical_name")).alias("key"))
    expected = {}
    words = lambda r: " ".join(sorted(r["canonical_name"].lower().split()))
    for a, b in combinations(sorted(r for r in keyed.where("merged_into IS NULL").collect()), 2):
        if a["type_id"] != b["type_id"]:
            continue
        pair = a["type_id"], a["entity_id"], b["entity_id"]
        score = likeness.indel_ratio(words(a), words(b))
        if a["key"] and a["key"] == b["key"]:
            expected[pair] = ("naive_key", 100.0)
        elif score >= 80 and a["key"] != b["key"]:
            one = entities.initials_differ(a["canonical_name"], b["canonical_name"])
            if one or entities.could_be_one(a["canonical_name"], b["canonical_name"]):
                expected[pair] = ("initials" if one else "similar", score)
    found = {r[1:3] for r in expected}
    assert {("e002", "e003"), ("e004", "e005")} <= found
    got = entities.duplicate_pages(pages).collect()
    assert len(got) == len(expected)
    assert {(r["type_id"], r["entity_id"], r["other_id"]): r["basis"] for r in got} == {k: v[0] for k, v in expected.items()}
    assert {(r["type_id"], r["entity_id"], r["other_id"]): r["score"] for r in got} == pytest.approx({k: v[1] for k, v in expected.items()})
    settled = spark.createDataFrame([("e002", "e003")], "entity_id string, other_id string")
    assert entities.duplicate_pages(pages, settled).count() == len(expected) - 1


def test_names_that_could_be_one_thing():
    assert not entities.could_be_one("EFTC OPERATING CORP.", "K*TEC OPERATING CORP.")
    assert entities.could_be_one("Sykes HealthPlan Services, Inc.", "HealthPlan Services, Inc.")
    assert entities.could_be_one("Halloran Instruments, Inc.", "Halloran Instrument Inc.")
    assert entities.initials_differ("Mitchell Felder", "Mitchell S. Felder")
    assert not entities.initials_differ("John A. Smith", "John B. Smith")
    assert not entities.initials_differ("John Paul Smith", "John Peter Smith")
    assert not entities.initials_differ("Cher", "Cher A.")


def test_conflict_and_corroboration(spark):
    rows = [("c", f"m{i}", f"d{i}", "address", v, True, False, e) for i, (v, e) in enumerate([("A", "x"), ("B", "y"), ("A", "x")])]
    claims = spark.createDataFrame([*rows, ("c", "m9", "d9", "address", "C", True, True, "z")], "entity_id string, instance_id string, document_id string, property_id string, value string, reviewed boolean, rejected boolean, excerpt string")
    assert [(r["n_values"], r["stated"]) for r in entities.conflicts(claims).collect()] == [(2, "A|B")]
    assert [(r["value"], r["n_documents"], r["independent"]) for r in entities.corroborated(claims).collect()] == [("A", 2, False)]


def test_only_the_first_break_is_reported(spark):
    rows = [(i, None if i == 0 else f"h{i - 1}", f"h{i}", f"h{i}", False) for i in range(10)]
    schema = "seq long, prev_hash string, row_hash string, expected string, payload_redacted boolean"
    broken = lambda: tuple(history.first_break(spark.createDataFrame(rows, schema)).select("n_unlinked", "n_redacted", "first_broken", "kind").first())
    assert broken() == (0, 0, None, None)
    rows[7] = (7, "h6", "h7", "other", True)  # a redacted payload is trusted
    assert broken() == (0, 1, None, None)
    rows[4] = (4, "h3", "bad", "h4", False)
    assert broken() == (0, 1, 4, "content")
    rows[2] = (2, None, None, None, False)  # no hash: the next row has nothing to hold against
    assert broken() == (1, 1, 4, "content")
    rows[6] = (6, "x", "h6", "h6", False)
    rows[4] = (4, "h3", "h4", "h4", False)
    assert broken() == (1, 1, 6, "link")


def test_sealed_log_verifies_until_it_is_changed(spark):
    log = spark.range(50).selectExpr("id AS seq", "concat('r', id % 7) AS row_id", "if(id % 3 = 0, NULL, 'é:1') AS note")
    sealed = history.seal(log, ["seq", "row_id", "note"])
    assert history.verify(sealed, ["seq", "row_id", "note"]).first()["first_broken"] is None
    changed = sealed.withColumn("note", F.when(F.col("seq") == 20, "x").otherwise(F.col("note")))
    assert history.verify(changed, ["seq", "row_id", "note"]).first()["first_broken"] == 20
    assert history.head(sealed).first()["seq"] == 49


def test_triage_unblocks_levels_first(spark):
    rows = [(f"i{lv}{n:02}", f"d{n % 4}", lv, "ai", "confirmed" if n < 2 else "unconfirmed") for lv, count in ((1.0, 30), (0.9, 6), (0.5, 3)) for n in range(count)]
    findings = spark.createDataFrame(rows, "instance_id string, document_id string, confidence double, source string, status string")
    queue = quality.triage(findings, 5, 10).collect()
    assert [r["first"] for r in queue[:6]] == [True] * 6
    assert {r["confidence"] for r in queue[:6]} == {1.0, 0.9}
    assert len({r["document_id"] for r in queue[:3]}) == 3


OLD_BUNDLE = {
    "bundle_id": "demo", "version": "0.1.0", "x": 1,
    "object_types": [{"id": "Company", "display_name": "Company", "table_name": "instances_Company", "primary_key": "instance_id", "implements": ["Named"], "properties": ["instance_id", "name", {"id": "size", "type": "int"}]}, {"id": "Empty", "properties": []}],
    "interfaceTypes": [{"id": "Named", "properties": ["name"]}],
    "link_types": [{"id": "owns", "from_type_id": "Company", "to_type_id": "Nobody", "join": {"fromKeys": ["instance_id"], "toKeys": ["instance_id"]}}],
    "concept_templates": [{"template_id": "t", "object_type_id": "Company", "base_sql_expr": "size > {{least}}", "parameters": {"least": {"type": "numeric", "default": 5e6}}}],
    "concept_defs": [{"id": "big", "object_type_id": "Company", "template_id": "t", "parameter_values": {"least": 1e6}}, {"id": "usual", "object_type_id": "Company", "template_id": "t"}],
    "extensions": {"domain": {"primaryObjectType": "Company", "valueProperty": "price"}},
}


def test_bundle(spark):
    made = bundle.normalise(OLD_BUNDLE)
    assert bundle.normalise(made) == made
    assert bundle.validate(made) == ["type Empty has no properties", "link owns ends at the unknown type Nobody", "valueProperty names price, which Company lacks"]
    assert [c["sqlExpr"] for c in made["concepts"]] == ["size > 1000000", "size > 5000000"]
    new = {"bundleId": "demo", "bundleVersion": "0.1.0", "objects": [{"id": "Person", "properties": [{"id": "name", "type": "string"}], "extensions": {"engine": {"managed": True, "nameStyle": "personal"}}, "source": {"table": "people"}}], "links": [], "interfaces": []}
    assert bundle.validate(bundle.normalise(new)) == ["no primary object type is named"]
    person = bundle.object_type(bundle.normalise(new), "Person")
    assert bundle.name_style(person) == "personal" and bundle.table_name(person) == "people"
    kind = bundle.object_type(made, "Company")
    assert bundle.name_style(kind) == "organisation" and bundle.managed(made) == [kind]
    assert [f.name for f in bundle.schema(kind).fields][:4] == ["instance_id", "document_id", "name", "size"]
    rows = bundle.migrate(spark.createDataFrame([("i", "unconfirmed", "X")], "instance_id string, status string, name string"), kind)
    assert rows.first()["size"] is None
    assert bundle.interface_union({"Company": rows}, made, "Named").first()["name"] == "X"
    with pytest.raises(ValueError, match="still holds"):
        bundle.drop_property(rows, "name")
    accepted = bundle.accept_property(made, "Company", "city")
    assert accepted["bundleVersion"] == "0.1.1" and "city" in bundle.property_ids(bundle.object_type(accepted, "Company"))
    assert bundle.accept_property(accepted, "Company", "city") == accepted


@pytest.mark.parametrize("value,sql", [(True, "TRUE"), (5e6, "5000000"), (0.1, "0.1"), (7, "7"), (None, "NULL"), ("O'Neil", "'O''Neil'"), (1e-7, "0.0000001"), (100, "100")])
def test_literals(value, sql):
    assert bundle.literal(value) == sql


def test_drafted_bundle():
    found = [{"kind": "type", "type_id": "Company"}, {"kind": "property", "type_id": "Company", "property_id": "name"}, {"kind": "property", "type_id": "Note", "property_id": "size", "data_type": "integer"}, {"kind": "link", "link_type_id": "about", "from": "Note", "to": "Company"}]
    made = bundle.draft(found, "mine", primary="Company")
    assert bundle.validate(made) == []
    assert "naive_key" in bundle.property_ids(bundle.object_type(made, "Company"))
    assert bundle.nameless(made) == ["Note has links but no name"]


def test_broken_concepts_are_reported(spark):
    rows = spark.createDataFrame([("i", 5)], "instance_id string, n int")
    fired, broken = corpus.evaluate_concepts(rows, {"fine": "n > 3", "bad": "missing > 3"})
    assert [(r["concept_id"], r["fired"]) for r in fired.collect()] == [("fine", True)]
    assert list(broken) == ["bad"]


def test_stream_counts(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:30:00", "confirm") for i in range(9)] + [(99, "2024-01-02 12:00:00", "amend")]
    events = spark.createDataFrame(rows, "seq long, t string, action string").selectExpr("seq", "cast(t AS timestamp) AS edited_at", "action")
    events.write.parquet(str(tmp_path / "in"))
    live = stream.counts(stream.tail(spark, str(tmp_path / "in"), events.schema))
    stream.run_once(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [3, 3, 3]


def test_benchmark_recall_of_short_labels(spark):
    labels = spark.createDataFrame([(1, "Needle"), (2, "two, words"), (3, "three words here"), (4, "four words are here"), (5, ""), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a needle"), (2, "x two words y three words here"), (3, "needles"), (4, "four words are here"), (5, "Needle"), (6, ""), (7, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in corpus.benchmark_recall(docs, labels).collect())
    assert got == [(1, 1), (2, 2), (2, 3), (4, 4), (5, 1)]
    assert corpus.benchmark_recall(docs, labels.where("false")).count() == 0


def test_lint_checks(spark):
    from lectern.plans import catalogue

    found = {r["check_name"]: r["n"] for r in catalogue.queries()["lint_findings"](spark, "/root/testdata/sf0.001").collect()}
    assert found["orphan_mention"] > 0 and found["unavailable_original"] > 0 and "unnamed_page" not in found
    names = ["Franchisee", "The Buyer.", "[.]", "", None, "Buyer Ltd", "Émile", "seller"]
    rows = [(str(i), "Company", n, "x" if i == 7 else None) for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "entity_id string, type_id string, canonical_name string, merged_into string")
    assert sorted(r["entity_id"] for r in entities.unnamed(pages).collect()) == ["0", "1", "2", "3", "4"]
