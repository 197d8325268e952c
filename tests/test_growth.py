"""Jobs whose work must not grow faster than their tables: plans without broadcasts of whole tables, groups of copies that are not expanded, numbers that are worked out once."""

import random

from lectern.operators import corpus, entities, extraction, graph, likeness, lint, review, search, survey, text
from lectern.plans import pages_queries
from lectern.sources.store import Store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_joined(df):
    """df's rows, and the most rows that one join of its plan gave out."""
    rows, most, rest = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind or "CartesianProduct" in kind:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        if kind == "AdaptiveSparkPlanExec":
            rest.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            rest.append(node.plan())
        else:
            rest += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_places_of_findings_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id AS document_id", "concat('for customer ', id, '.') AS text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = extraction.populate(docs, lambda text: [{"type_id": "Company", "quote": "customer", "confidence": 0.9}, {"type_id": "Clause", "quote": "zebras", "confidence": 1.0}]).withColumnRenamed("document_id", "doc_id")
    offsets = docs.selectExpr("document_id AS doc_id", "1 AS page_no", "0 AS start", "6 AS end_").union(docs.selectExpr("document_id", "2", "4", "90"))
    placed = extraction.provenance(found, offsets, "ai_local")
    assert "Broadcast" not in plan_of(placed)
    assert {tuple(r) for r in placed.groupBy("page_no", "excerpt").count().collect()} == {(2, "customer", 2000), (None, "zebras", 2000)}


def test_register_identifiers_are_counted_once_a_name(spark):
    named = spark.range(400).selectExpr("id AS entity_id", "concat('n', id % 2) AS name_key").union(spark.createDataFrame([(7, "n0"), (900, None), (901, "none")], "entity_id long, name_key string"))
    register = spark.range(400).selectExpr("concat('n', id % 2) AS name_key", "CASE WHEN id % 2 = 0 THEN 'a' ELSE concat('b', id % 3) END AS identifier")
    rows, most = most_joined(corpus.register_matches(named, register))
    got = {r["entity_id"]: (r["n_identifiers"], r["identifier"], r["outcome"]) for r in rows}
    assert len(rows) == 400 and got[0] == (1, "a", "proposal") and got[1] == (3, "b0", "ambiguous") and got[7] == (4, "a", "ambiguous")
    assert most <= 500


def test_labels_of_equal_texts_are_compared_once(spark):
    labels = spark.range(300).selectExpr("'t' AS title", "'C' AS category", "concat('The part ', id % 2, CASE WHEN id % 3 = 0 THEN ' zebra' ELSE '' END) AS text", "id % 5 > 0 AS present")
    found = spark.range(300).selectExpr("'t' AS title", "'c' AS clause_type", "concat('Part ', CASE WHEN id % 2 = 0 THEN '0' ELSE '1 zebra' END) AS text")
    rows, most = most_joined(corpus.scored_labels(labels, found, {"C": "c"}))
    kept = [i for i in range(300) if i % 5]
    hit = [i for i in kept if i % 2 == 0 or i % 3 == 0]
    assert [(r["n_labelled"], r["n_found"], r["recall"]) for r in rows] == [(len(kept), len(hit), round(len(hit) / len(kept), 3))]
    assert most <= 300


def test_events_are_numbered_in_order_when_partitions_are_put_together(spark):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "150k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(5000).selectExpr("concat('r', lpad(cast(id * 7919 % 5000 AS string), 6, '0')) AS row_id", "concat_ws('', sha2(cast(id AS string), 512), sha2(cast(id + 1 AS string), 512)) AS document_id")
        got = sorted((r["seq"], r["row_id"]) for r in review.events(rows, "confirm", "ana", "2024-01-01", 1000).select("seq", "row_id", "document_id").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(1000 + i, f"r{i:06d}") for i in range(5000)]


NAMES = ["Acme Trading", "Acme Trading Ltd", "Trading Acme", "Acme Tradings", "Blue Fox", "blue fox", "John Smith", "John Q. Smith", "", None]


def test_classes_stand_for_all_pairs_of_pages(spark):
    rows = [(f"e{i:03d}", "T" if i % 3 else "U", NAMES[i * 7 % 10], None) for i in range(90)] + [("e500", "T", "Acme Trading", "e001"), ("e501", "T", "Zebra", None)]
    pages = spark.createDataFrame(rows, "entity_id string, type_id string, canonical_name string, merged_into string")
    members, pairs = entities.duplicate_classes(pages)
    held: dict[str, list[str]] = {}
    for r in members.collect():
        held.setdefault(r["class_id"], []).append(r["entity_id"])
    assert sum(map(len, held.values())) == 91
    got = set()
    for r in pairs.collect():
        own = {(min(a, b), max(a, b), r["basis"], r["score"]) for a in held[r["class_id"]] for b in held[r["other_id"]] if a != b}
        assert len(own) == r["n_pairs"] and not own & got
        got |= own
    expected = entities.duplicate_pages(pages)
    assert got == {(r["entity_id"], r["other_id"], r["basis"], r["score"]) for r in expected.collect()}
    mentions = pages.selectExpr("entity_id", "false AS unlinked")
    for limit in (5, 50):
        first, most = most_joined(entities.ranked_offers(entities.first_pairs(members, pairs, limit), mentions, limit))
        assert sorted(first) == sorted(entities.ranked_offers(expected, mentions, limit).collect())


def test_copies_of_a_name_are_not_expanded(spark):
    pages = spark.range(1000).selectExpr("concat('e', lpad(cast(id AS string), 5, '0')) AS entity_id", "'T' AS type_id", "concat(CASE WHEN id % 2 = 0 THEN 'large ring' ELSE 'large rings' END) AS canonical_name", "CAST(NULL AS STRING) AS merged_into")
    found, most = most_joined(lint.split_pages(pages))
    assert len(found) == 999 and most <= 2000


def test_components_that_a_task_holds_are_walked_apart(spark, monkeypatch):
    rng = random.Random(7)
    links = [(f"{c}{rng.randrange(12):02d}", f"{c}{rng.randrange(12):02d}") for c in "ABCDEF" for _ in range(14)] + [(f"Z{i:02d}", f"Z{rng.randrange(40):02d}") for i in range(40) for _ in range(2)]
    df = spark.createDataFrame(links, "a string, b string")
    same = lambda rows: sorted((r[0], round(r[1], 7)) for r in rows)
    whole = {k: sorted(f().collect()) for k, f in (("components", lambda: graph.components(df)), ("cut", lambda: graph.articulation_points(df)))}
    central = {k: same(graph.betweenness(df, k).collect()) for k in (None, 9)}
    monkeypatch.setattr(graph, "SMALL", 40)
    monkeypatch.setattr(graph, "SINGLE", 0)
    monkeypatch.setattr(graph, "WALK", 60)
    assert sorted(graph.components(df).collect()) == whole["components"]
    groups, large = graph.in_groups(df)
    assert {r["a"][0] for r in large.collect()} == {"Z"} and {r["group"] for r in groups.collect()}
    assert sorted(graph.articulation_points(df).collect()) == whole["cut"]
    for k in central:
        assert same(graph.betweenness(df, k).collect()) == central[k]


def test_mentions_elsewhere_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(i, i * 5 % 11, "PQ"[i * 3 % 7 % 2], f"name {i % 9}", f"k{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "instance_id long, document_id long, type_id string, name string, name_key string")
    links = df.where("instance_id % 3 = 0").selectExpr("instance_id", "concat('p', instance_id % 5) AS entity_id", "'confirmed' AS status", "false AS unlinked")
    got = {r["instance_id"]: (r["n_documents"], r["n_cross_type"], r["n_other_names"]) for r in entities.matches_elsewhere(df.mapInPandas(run, df.schema), links).collect()}
    assert seen.value == 60
    for i, d, t, _, k in rows:
        near = [r for r in rows if r[0] % 3 == 0 and r[0] % 5 == i % 5] if i % 3 == 0 else [r for r in rows if r[4] == k]
        assert got[i] == (len({r[1] for r in near if r[2] == t} - {d}), len({r[1] for r in near if r[2] != t} - {d}), len({r[3] for r in near}) - 1)


def test_texts_are_read_into_words_once(spark, tmp_path, monkeypatch):
    plans, write = {}, Store.transaction

    def seen(store, changes, **more):
        plans.update({k: plan_of(v) for k, v in changes.items()})
        return write(store, changes, **more)

    monkeypatch.setattr(Store, "transaction", seen)
    index = search.Index(Store(spark, f"file://{tmp_path}"), "pages", ["id"])
    docs = spark.createDataFrame([(i, f"Ünïque wörd{i} of the running runs") for i in range(40)], "id long, text string")
    assert index.add(docs) == 40
    # Dealing out by ranges looks at its rows twice, so they must be read from where they were written.
    assert not [m for m in ("MapInArrow", "MapInPandas") if m in plans["pages_postings"]]
    assert {(r["id"], r["n"], r["first"]) for r in index.search("unique run").collect()} == {(i, 3, 0) for i in range(40)}


def test_triangles_are_looked_for_where_few_links_leave(spark):
    links = [(f"c{i:02d}", f"s{j:02d}") for i in range(60) for j in range(20)] + [("s00", "s01"), ("s01", "s02"), ("s01", "s00"), ("s05", "s05")]
    rows, most = most_joined(graph.triangles(spark.createDataFrame(links, "a string, b string")))
    expected = {frozenset((f"c{i:02d}", f"s{j:02d}", f"s{j + 1:02d}")) for i in range(60) for j in (0, 1)}
    assert len(rows) == len(expected) and {frozenset(r) for r in rows} == expected
    # Pairs of links that leave one customer are 11,400.
    assert most <= 3000


def counted_links(spark):
    """A graph of 200 links, and how many rows of it were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(200).selectExpr("concat('s', id % 10) AS a", "concat('c', id % 37) AS b")
    return df.mapInPandas(run, df.schema), seen


def test_links_of_paths_are_worked_out_once(spark):
    links, seen = counted_links(spark)
    got = [r["path"] for r in pages_queries._between(links, 6, 5).collect()]
    assert got == ["s0>c0"] + sorted(got[1:]) and len(got) == 5 and {p.count(">") for p in got[1:]} == {3}
    assert seen.value == 200


def test_links_around_a_node_are_worked_out_once(spark):
    links, seen = counted_links(spark)
    got = {tuple(r) for r in pages_queries._around(links).collect()}
    both = {(f"s{i % 10}", f"c{i % 37}") for i in range(200)}
    one = {"s0"} | {b for a, b in both if a == "s0"}
    two = one | {a for a, b in both if b in one}
    assert got == {(b, a) for a, b in both if {a, b} <= two}
    assert seen.value == 200


def test_names_are_compared_only_for_the_bases_that_it_gives(spark):
    pages = spark.createDataFrame([(f"e{i}", "T", f"Maker {w}", f"i{i}", None) for i, w in enumerate(("zebra", "zebras", "apple", "pear"))], "entity_id string, type_id string, canonical_name string, identifier string, merged_into string")
    mentions = spark.createDataFrame([("m0", "T", "Maker zebra Ltd", "i3"), ("m1", "T", "Maker pear Ltd", None)], "instance_id string, type_id string, name string, identifier string")
    told = lambda df: {(r["instance_id"], r["entity_id"], r["basis"]) for r in df.collect()}
    whole, strong = entities.candidates_for(mentions, pages), entities.candidates_for(mentions, pages, bases=["identifier", "naive_key"])
    assert told(strong) == {("m0", "e3", "identifier"), ("m0", "e0", "naive_key"), ("m1", "e3", "naive_key")}
    assert told(strong) == {r for r in told(whole) if r[2] in ("identifier", "naive_key")}
    assert "MapInPandas" in plan_of(whole) and "MapInPandas" not in plan_of(strong)


def test_header_fields_are_read_in_their_rows(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id % 500 AS document_id", "concat('Order: ', id, '\n  and on\nStatus: x\nPriority: ', id % 2, '\n\nBody') AS header")
    plan = plan_of(text.header_fields(docs, "header"))
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert text.header_fields(docs, "header").count() == 1800  # texts of one id are not mixed
    monkeypatch.setattr(survey, "PER_TASK", 100)
    fields = survey.told_fields(docs, "header")
    assert fields.rdd.getNumPartitions() == 18
    assert {tuple(r) for r in survey.supported(fields).collect()} == {("order", 500, "string"), ("status", 500, "string"), ("priority", 500, "integer")}


def test_near_words_meet_only_where_they_are_near(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice(["an", "el", "jo", "ma", "vi", "ni", "lu", "to", "sa"]) for _ in range(rng.randint(3, 5))) for _ in range(2000)}
    rows, most = most_joined(likeness.near_words(spark.createDataFrame([(w,) for w in words], "word string"), 85.0))
    assert {tuple(r) for r in rows} == {(a, b) for a in words for b in words if a != b and likeness.indel_ratio(a, b) >= 85}
    assert most <= len(rows)


def test_near_words_on_both_sides_of_the_longest_joined(spark):
    rng = random.Random(12)
    longest = likeness.longest_joined(85.0)
    words = set()
    for n in [*range(longest - 3, longest + 5)] * 4:
        word = [rng.choice("abcdé") for _ in range(n)]
        for _ in range(5):
            words.add("".join(word))
            word = word[:]
            word.pop(rng.randrange(len(word))) if rng.random() < 0.5 else word.insert(rng.randrange(len(word)), rng.choice("abcdé"))
    rows = [tuple(r) for r in likeness.near_words(spark.createDataFrame([(w,) for w in words], "word string"), 85.0).collect()]
    want = {(a, b) for a in words for b in words if a != b and likeness.indel_ratio(a, b) >= 85}
    assert len(rows) == len(want) and set(rows) == want
    assert any(len(a) <= longest < len(b) for a, b in want)
