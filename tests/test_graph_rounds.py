"""What goes by rounds of joins gives what a walk gives, on both sides of every switch."""

import random
from functools import partial
from itertools import combinations

import numpy as np
import pytest

from lectern.operators import graph


def adjacency(links):
    return graph.adjacency_of(*(np.array(x, dtype=object) for x in zip(*links, strict=True)))


def random_links(rng, graphs):
    links = []
    for g in range(graphs):
        n = rng.randint(2, 9)
        kind = rng.choice(["sparse", "dense", "path", "ring of rings"])
        pairs = {"sparse": rng.sample([*combinations(range(n), 2)], min(n, n * (n - 1) // 2)), "dense": [p for p in combinations(range(n), 2) if rng.random() < 0.5]}.get(kind)
        if kind == "path":
            pairs = [(i, i + 1) for i in range(n)]
        elif kind == "ring of rings":
            pairs = [(i, (i + 1) % n) for i in range(n)] + [(i, 20 + i) for i in range(n)] + [(20 + i, 40 + i) for i in range(n)] + [(40 + i, i) for i in range(0, n, 2)]
        links += [(f"g{g:03}-{a:02}", f"g{g:03}-{b:02}") for a, b in pairs or [(0, 1)]]
    return [*links, ("loop", "loop"), *links[:20], *[(b, a) for a, b in links[20:40]]]


def members_of(found):
    members = {}
    for r in graph.block_members(found).collect():
        members.setdefault(r["block"], set()).add(r["node"])
    return members


def test_cut_vertices_and_blocks_of_two_hundred_graphs(spark):
    links = random_links(random.Random(40), 200)
    walked = adjacency(links)
    expected = graph.cut_vertices(walked)
    assert len(expected) > 300
    df = graph.kept(spark.createDataFrame(links, "a string, b string"))
    assert {r["node"] for r in graph.articulation_points(df).collect()} == expected
    members = members_of(graph.blocks(df))
    # Far fewer links do for the cut vertices.
    fewer = [(r["a"], r["b"]) for r in graph.certificate(df).collect()]
    assert len(fewer) <= 2 * len(walked) and {frozenset(x) for x in fewer} <= {frozenset(x) for x in links}
    assert graph.cut_vertices(adjacency(fewer)) == expected
    # No node parts a block, every link is in exactly one, and a cut vertex is in several.
    for block in members.values():
        own = [(a, b) for a in block for b in walked[a] if b in block]
        assert not graph.cut_vertices(adjacency(own))
    where = {n: {k for k, b in members.items() if n in b} for n in walked}
    assert all(len(where[a] & where[b]) == 1 for a in walked for b in walked[a])
    assert {n for n, blocks in where.items() if len(blocks) > 1} == expected


def test_nothing_is_walked_in_a_large_graph(spark, monkeypatch):
    links = random_links(random.Random(43), 8)
    monkeypatch.setattr(graph, "WALKED", 0)
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "in_one_task", None)
    monkeypatch.setattr(graph, "arrays_in_one_task", None)
    df = graph.kept(spark.createDataFrame(links, "a string, b string"))
    assert {r["node"] for r in graph.articulation_points(df).collect()} == graph.cut_vertices(adjacency(links))


def score(spark, df, labels):
    return graph.modularity(df, labels).first()["modularity"]


@pytest.mark.parametrize("kind", ["planted"])  # the graphs of communities are walked, their nodes not
def test_communities_by_rounds_are_as_good_as_walked_ones(spark, monkeypatch, kind):
    rng = random.Random(41)
    if kind == "planted":
        links = [(a, b) for a, b in combinations(range(100), 2) if rng.random() < (0.5 if a // 20 == b // 20 else 0.01)]
    else:
        links = [(a, b) for a, b in combinations(range(80), 2) if rng.random() < 0.04]
    df = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in links], "a string, b string")
    walked = score(spark, df, graph.communities(df, "louvain"))
    monkeypatch.setattr(graph, "WALKED", df.count() // 2)
    labels = graph.kept(graph.communities(df, "louvain"))
    assert labels.groupBy("node").count().where("count > 1").isEmpty()
    assert score(spark, df, labels) >= walked - 0.02
    rows = labels.collect()
    least = {}
    for r in rows:
        least[r["community"]] = min(least.get(r["community"], "z"), r["node"])
    assert all(k == v for k, v in least.items())


def test_labels_by_rounds_keep_cliques_together(spark, monkeypatch):
    ring = lambda name, n: [(f"{name}{i}", f"{name}{j}") for i, j in combinations(range(n), 2)]
    df = spark.createDataFrame([*ring("a", 6), *ring("b", 6), *ring("c", 6), ("a0", "b0"), ("b1", "c1")], "a string, b string")
    monkeypatch.setattr(graph, "WALKED", 0)
    found = {r["node"]: r["community"] for r in graph.communities(df, "label_propagation").collect()}
    assert all(len({c for k, c in found.items() if k[0] == clique}) == 1 for clique in "abc")


def test_sampled_betweenness_is_the_same_on_every_path(spark, monkeypatch):
    rng = random.Random(42)
    links = [(f"n{a:02}", f"n{b:02}") for a, b in combinations(range(60), 2) if rng.random() < 0.08]
    df = spark.createDataFrame(links, "a string, b string")
    found = []
    for small, single in ((graph.SMALL, graph.SINGLE), (graph.SMALL, 5), (5, 5)):
        monkeypatch.setattr(graph, "SMALL", small)
        monkeypatch.setattr(graph, "SINGLE", single)
        found.append({r["node"]: round(r["betweenness"], 7) for r in graph.betweenness(df, 10).collect()})
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("method", ["label_propagation", "louvain"])
def test_rounds_over_arrays_are_the_rounds_by_joins(spark, monkeypatch, method):
    """components that a task holds go over arrays, with the partition that the joins give; these are no broadcasts."""
    rng = random.Random(44)
    links = [(f"n{a:03}", f"n{b:03}") for a, b in combinations(range(40), 2) if rng.random() < (0.6 if a // 10 == b // 10 else 0.02)]
    df = graph.kept(spark.createDataFrame([*links, links[0], links[0][::-1], ("n000", "n000")], "a string, b string"))
    monkeypatch.setattr(graph, "WALKED", 60)
    monkeypatch.setitem(graph.IN_ARRAYS, method, (partial(graph.IN_ARRAYS[method][0], rounds=3), 3))
    over_arrays = {tuple(r) for r in graph.communities(df, method).collect()}
    plans = []

    def keep(df, kept=graph.kept):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(graph, "kept", keep)
    by_joins = {}
    for r in graph.BY_ROUNDS[method](df, 3).collect():
        by_joins.setdefault(r["community"], []).append(r["node"])
    assert over_arrays == {(n, min(nodes)) for nodes in by_joins.values() for n in nodes} and len({c for _, c in over_arrays}) > 1
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_components_are_apart_in_a_large_graph(spark, monkeypatch):
    ring = lambda name, n: [(f"{name}{i}", f"{name}{j}") for i, j in combinations(range(n), 2)]
    df = graph.kept(spark.createDataFrame([*ring("a", 4), *ring("b", 3), *ring("c", 6)], "a string, b string"))
    monkeypatch.setattr(graph, "WALKED", 0)
    asked = []
    monkeypatch.setitem(graph.BY_ROUNDS, "label_propagation", lambda links, total: asked.append(links.count()) or graph.propagated_by_rounds(links))
    monkeypatch.setattr(graph, "SMALL", 10)
    found = {r["node"]: r["community"] for r in graph.communities(df).collect()}
    assert found == {n: n[0] + "0" for n in found} and len(found) == 13
    assert asked == [15]  # the others are held by a task each
