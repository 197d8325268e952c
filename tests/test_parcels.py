"""Links that go to tasks as parcels of a component, and what a task does with them: the same as node by node, for less."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from lectern.operators import graph, lint


def graphs(n_graphs):
    """(u, v, n) of random graphs, some of them of two sides, without nodes that have no link."""
    for seed in range(n_graphs):
        rng = random.Random(seed)
        n, p = rng.randint(2, 30), rng.choice([0.05, 0.1, 0.3, 0.8])
        links = [(a, b) for a, b in combinations(range(n), 2) if rng.random() < p and (seed % 3 or a % 4 == 0 and b % 4)] or [(0, 1)]
        nodes, codes = np.unique(links, return_inverse=True)
        u, v = codes.reshape(-1, 2).T
        yield rng, u, v, len(nodes)


def named(spark, links):
    return graph.kept(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in links], "a string, b string"))


def asked(spark, df, run):
    """How often the rows of df are asked for by run."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    run(df.mapInPandas(told, df.schema)).collect()
    return seen.value


def test_paths_by_hubs_are_those_of_all_levels(monkeypatch):
    """products with the table of hubs give what a walk of all nodes gives, on both sides of the switch between table and lists."""
    n_found = 0
    for rng, u, v, n in graphs(120):
        sources = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        start, other = graph.around_each(u, v, n)
        expected = graph.dependencies(start, other, sources)
        for sparse in (0, 10**9):
            monkeypatch.setattr(graph, "SPARSE", sparse)
            found = graph.dependencies_by_hubs(u, v, n, sources)
            if found is not None:
                n_found += 1
                assert np.allclose(found, expected, rtol=1e-9, atol=1e-9)
    assert n_found > 200


def test_links_are_parcels(spark, monkeypatch):
    """a component's links are a row of numbers for each part, which are told once, whichever way round and however often they are given."""
    rng = random.Random(5)
    links = [(50 * c + rng.randrange(12), 50 * c + rng.randrange(12)) for c in range(3) for _ in range(60)]
    df = named(spark, [*links, *[(b, a) for a, b in links[:20]]])
    expected = {tuple(sorted((f"n{a:03}", f"n{b:03}"))) for a, b in links if a != b}
    monkeypatch.setattr(graph, "SMALL", len(expected))
    parcels = graph.parcelled(graph.ordered(df))
    assert 3 <= parcels.count() <= 3 * 4
    assert sorted(tuple(r) for r in graph.links_in(parcels).collect()) == sorted(expected)
    groups, large, nodes = graph.placed(df)
    assert large.isEmpty() and {r["component"] for r in nodes.collect()} == {f"n{min(x for k in links if k[0] // 50 == c and k[0] != k[1] for x in k):03}" for c in range(3)}
    assert {r["component"]: r["n"] for r in groups.groupBy("component").agg({"size": "sum"}).toDF("component", "n").collect()} == {r["component"]: r["n_links"] for r in nodes.collect()}


def test_betweenness_asks_for_its_links_once(spark, monkeypatch):
    """what tells the links is worked out once, however many jobs look at them."""
    links = [(a, b) for a, b in combinations(range(24), 2) if a // 8 == b // 8]
    monkeypatch.setattr(graph, "SINGLE", 10)
    monkeypatch.setattr(graph, "SMALL", 60)
    assert asked(spark, named(spark, links), lambda df: graph.betweenness(df, 5)) == len(links)


def test_few_labels_are_counted_without_sorting(monkeypatch):
    """once few labels are left, rounds don't sort the links."""
    u, v = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20, 40)))
    goes = np.random.default_rng(3).integers(0, 2**50, 40)
    n_sorts, sort = [], np.sort
    monkeypatch.setattr(graph.np, "sort", lambda *x, **y: n_sorts.append(1) or sort(*x, **y))
    label = graph.propagated_in_arrays(np.r_[u, v], np.r_[v, u], goes, 800.0, 0)
    assert len(n_sorts) < 10 and len(label) == 40


def test_triangles_are_looked_for_about_cut_vertices_only(spark, monkeypatch):
    """what has no cut vertex near is left out."""
    links = [*combinations(range(8), 2), (7, 20), (20, 21), *combinations(range(21, 25), 2), *combinations(range(40, 52), 2)]
    seen, triangles = [], graph.triangles
    monkeypatch.setattr(graph, "triangles", lambda df: seen.append(df.count()) or triangles(df))
    found = {r["via"]: r["n_pairs"] for r in graph.shared_neighbours(named(spark, links)).collect()}
    near = {n: {a + b - n for a, b in links if n in (a, b)} for n in (7, 20, 21)}
    assert found == {f"n{n:03}": sum((a, b) not in links for a, b in combinations(sorted(near[n]), 2)) for n in near}
    assert seen == [len(links) - 66]


def test_certificates_of_parts_keep_cut_vertices():
    """parts of a graph are thinned apart from each other, and what is left has the same cut vertices."""
    n_cut = 0
    for rng, u, v, n in graphs(150):
        names = np.array([f"{i:03}" for i in range(n)], dtype=object)
        expected = graph.cut_vertices(graph.adjacency_of(names[u], names[v]))
        assert {names[i] for i in graph.cut_places(u, v, n)} == expected
        part = np.array([rng.randrange(3) for _ in u])
        fewer = [np.concatenate(x) for x in zip(*[graph.certified(names, u[part == k], v[part == k]) for k in range(3)], strict=True)]
        assert {names[i] for i in graph.cut_places(*fewer, n)} == expected
        n_cut += len(expected)
    assert n_cut > 200


def test_cut_vertices_of_a_dense_graph_take_no_rounds(spark, monkeypatch):
    """tasks thin their parts until one can hold the rest."""
    links = [(a, 30 + b) for a in range(30) for b in range(30)] + [(0, 70), (70, 71)]
    monkeypatch.setattr(graph, "SMALL", 400)
    monkeypatch.setattr(graph, "certificate", None)
    monkeypatch.setattr(graph, "WALKED", 10)
    assert {r["node"] for r in graph.articulation_points(named(spark, links)).collect()} == {"n000", "n070"}


def test_long_chains_are_thinned():
    u = np.arange(3000)
    assert [len(x) for x in graph.certified(pa.array([str(i) for i in range(3001)]), u, u + 1)] == [3000, 3000]
    assert list(graph.cut_places(u, u + 1, 3001)) == list(range(1, 3000))


def test_mentions_are_told_apart_at_cut_vertices_only(spark):
    """mentions of other nodes are left out before equal ones are looked for."""
    spark.createDataFrame([(f"n{i:03}", "confirmed", False) for i in range(5)] * 2, "entity_id string, status string, unlinked boolean").createOrReplaceTempView("told_mentions")
    found = lint.fragile_joins(named(spark, [(1, 2), (2, 3), (9, 10), (10, 11)]), spark.sql("SELECT DISTINCT * FROM told_mentions"))
    assert [r["subject"] for r in found.collect()] == ["n010"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.index("LeftSemi") > plan.index("Aggregate")
