"""The relation graph: canonical edges, degrees, components, cut vertices, paths, communities."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of a graph of so many links at most are found by one task, which spares the rounds of jobs that larger ones need;
#: betweenness from all sources is dealt out from fewer on, and walks over dictionaries (cut vertices, communities) end at fewer still.
SMALL, SINGLE, WALKED = 1_000_000, 5_000, 50_000


def statements(edges: DataFrame, mentions: DataFrame, entities: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """Statements with the pages at both ends: live links, one merge hop, no loops."""
    wanted = F.col("status").isin("confirmed", "amended") if reviewed_only else F.col("status") != "rejected"
    page = entities.select("entity_id", F.coalesce("merged_into", "entity_id").alias("page"))
    live = mentions.where("NOT unlinked").select("instance_id", "entity_id").join(page, "entity_id").drop("entity_id")
    ends = edges.where(wanted)
    for side in ("from", "to"):
        ends = ends.join(live.select(F.col("instance_id").alias(f"{side}_instance_id"), F.col("page").alias(f"{side}_page")), f"{side}_instance_id")
    return ends.where("from_page <> to_page")


def canonical_edges(edges: DataFrame, mentions: DataFrame, entities: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """Statements grouped to one edge between pages."""
    grouped = statements(edges, mentions, entities, reviewed_only).groupBy("from_page", "link_type_id", "to_page")
    return grouped.agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("document_id").alias("n_documents"), F.count_if(F.col("status").isin("confirmed", "amended")).alias("n_confirmed"), F.max("confidence").alias("max_confidence"))


def coverage(edges: DataFrame, mentions: DataFrame, types: DataFrame | None = None, named: list[str] | None = None) -> DataFrame:
    """One row: live statements; those that both ends' live links make an edge of pages; those whose ends are both of named types (types: instance_id, type_id), the backlog among them, and the others, which never get a page."""
    live = mentions.where("NOT unlinked").select("instance_id")
    own = edges.where("status <> 'rejected'")
    ends = lambda held: own.join(held.withColumnRenamed("instance_id", "from_instance_id"), "from_instance_id", "left_semi").join(held.withColumnRenamed("instance_id", "to_instance_id"), "to_instance_id", "left_semi")
    able = live if types is None else types.where(F.col("type_id").isin(named or [])).select("instance_id")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(own, "n_edges").crossJoin(one(ends(live), "n_projected")).crossJoin(one(ends(able) if types is not None else own, "n_projectable"))  # single rows
    rate = F.when(F.col("n_edges") > 0, F.round(F.col("n_projected") / F.col("n_edges"), 3))
    return out.select("*", F.greatest(F.col("n_projectable") - F.col("n_projected"), F.lit(0)).alias("n_awaiting"), F.greatest(F.col("n_edges") - F.col("n_projectable"), F.lit(0)).alias("n_structural"), rate.alias("projected_rate"))


def neighbours(links: DataFrame) -> DataFrame:
    """(a, b) of undirected links, both ways, once."""
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def degrees(links: DataFrame) -> DataFrame:
    return neighbours(links).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def isolates(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(neighbours(links).select(F.col("a").alias("node")), "node", "left_anti")


def kept(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the checkpoint folder where there is one, once, which ``checkpoint`` would work out twice; else (tests) in memory."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        return df.persist()
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def adjacency_of(a: np.ndarray, b: np.ndarray) -> dict[str, list[str]]:
    """Sorted neighbours of each node of undirected links, loops and repeats left out."""
    found: dict[str, set[str]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if x != y:
            found.setdefault(x, set()).add(y)
            found.setdefault(y, set()).add(x)
    return {k: sorted(found[k]) for k in sorted(found)}


def arrays_in_one_task(links: DataFrame, function: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """function(a, b) over the ends of all links of a graph that was found to be small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [*batches]
        if frames:
            both = pd.concat(frames)
            yield function(both["a"].to_numpy(), both["b"].to_numpy())

    return links.select("a", "b").coalesce(1).mapInPandas(run, schema)


def in_one_task(links: DataFrame, function: Callable[[dict[str, list[str]]], pd.DataFrame], schema: str) -> DataFrame:
    """function(adjacency) of a graph that was found to be small."""
    return arrays_in_one_task(links, lambda a, b: function(adjacency_of(a, b)), schema)


def is_small(links: DataFrame, most: int | None = None) -> bool:
    most = SMALL if most is None else most
    return links.select("a").limit(most + 1).count() <= most


def least_reachable(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(node, component) of undirected links, by hooking the larger root on to the smaller and halving paths."""
    codes, names = pd.factorize(np.concatenate([a, b]), use_na_sentinel=False)
    return least_of(codes, names)


def least_of(codes: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """The same of links told by their ends' places in names: first those of all one ends, then those of all others."""
    names, order = np.unique(names.astype(str), return_inverse=True)  # names are sorted once each, not once a link
    u, v = order[codes[: len(codes) // 2]], order[codes[len(codes) // 2 :]]
    linked = np.zeros(len(names), dtype=bool)
    linked[u[u != v]] = linked[v[u != v]] = True
    label = least_places(u, v, len(names))
    return pd.DataFrame({"node": names[linked], "component": names[label[linked]]}, dtype=object)


def least_places(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes reaches over links u, v."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return label
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def components(links: DataFrame, rounds: int = 200, held: bool = False) -> DataFrame:
    """(node, component): the smallest reachable node; in one task if the graph is small, else by spreading minima with pointer jumping until nothing changes. Links that are held are written down already, without loops."""
    if not is_small(links):
        links = thinned(links, held)
    if is_small(links):
        return arrays_in_one_task(links, least_reachable, "node string, component string")
    return components_by_rounds(links, rounds)


def numbered(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of links (a, b), in order, and the different links u < v by the numbers of their ends, without loops."""
    ends = pa.concat_arrays([p.column(k) for k in (0, 1) for p in parts]).dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    u, v = place[ends.indices.to_numpy()].reshape(2, -1)
    key = different((np.minimum(u, v) * len(order) + np.maximum(u, v))[u != v])
    return ends.dictionary.take(pa.array(order)), key // max(1, len(order)), key % max(1, len(order))


def different(x: np.ndarray) -> np.ndarray:
    """The different numbers, all 0 at least, in order; of many, sooner than np.unique."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


def starred(names: pa.Array, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star in place of each component."""
    label = least_places(u, v, len(names))
    off = np.flatnonzero(label != np.arange(len(names)))
    return label[off], off


def thinned(links: DataFrame, held: bool = False, pick: Callable[..., tuple[np.ndarray, np.ndarray]] = starred) -> DataFrame:
    """Fewer links that tell the same, as components or what else pick keeps: each task puts pick(nodes, u, v) in place of its part, again as long as that halves them."""
    links = links if held else kept(links.select("a", "b").where("a <> b"))
    n = links.count()

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [*batches]
        if parts:
            names, u, v = numbered(parts)
            u, v = pick(names, u, v)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(u)), names.take(pa.array(v))], names=["a", "b"])

    while n > SMALL > 0:
        fewer = kept(links.repartitionByRange(-(-2 * n // SMALL), "a", "b").mapInArrow(picked, "a string, b string"))
        m = fewer.count()
        if m > n // 2:
            return links if m > n else fewer
        links, n = fewer, m
    return links


PARCEL = "least string, nodes array<string>, u binary, v binary, size long"


def ordered(links: DataFrame) -> DataFrame:
    """Links a < b, written down."""
    return kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))


def parcelled(links: DataFrame) -> DataFrame:
    """Links (a, b), a < b, as parcels: each task's part makes a row of each component that it has, of its nodes in order and the places of the ends of its different links among them.

    Equal links are in one part, so that each is told once. A link takes 8 bytes, not the names of both ends.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [*batches]
        if not parts:
            return
        names, u, v = numbered(parts)
        label = least_places(u, v, len(names))
        by = np.argsort(label, kind="stable")
        least, first = np.unique(label[by], return_index=True)
        starts = np.append(first, len(by))
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by)) - np.repeat(first, np.diff(starts))
        order = np.argsort(label[u], kind="stable")
        u, v = u[order], v[order]
        ends = np.append(np.searchsorted(label[u], least), len(u))
        raw = [pa.Array.from_buffers(pa.binary(), len(least), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(place[x].astype(np.int32))]) for x in (u, v)]
        nodes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), names.take(pa.array(by)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(least)), nodes, *raw, pa.array(np.diff(ends), pa.int64())], names=["least", "nodes", "u", "v", "size"])

    n = links.count()
    return kept(links.repartitionByRange(max(1, -(-2 * n // max(1, SMALL))), "a", "b").mapInArrow(pack, PARCEL))


def unpacked(parcels: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of some parcels, in order, and the numbers of the ends of their links."""
    nodes = pa.concat_arrays([c.flatten() for c in parcels["nodes"].chunks]).dictionary_encode()
    starts = np.cumsum([0, *pc.list_value_length(parcels["nodes"]).to_pylist()])[:-1]
    order = pc.array_sort_indices(nodes.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    codes = place[nodes.indices.to_numpy()]
    base = np.repeat(starts, parcels["size"].to_numpy())
    u, v = (codes[np.frombuffer(b"".join(parcels[c].to_pylist()), dtype=np.int32) + base] for c in "uv")
    return nodes.dictionary.take(pa.array(order)), u, v


def links_in(parcels: DataFrame) -> DataFrame:
    """The links (a, b) of parcels, with a component and a group if these are told."""
    told = [c for c in ("component", "group") if c in parcels.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                names, u, v = unpacked(row)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in (u, v)] + [pa.repeat(row[c][0], len(u)) for c in told], names=["a", "b", *told])

    return parcels.select("nodes", "u", "v", "size", *told).mapInArrow(run, ", ".join(f"{c} string" for c in ["a", "b", *told]))


def placed(links: DataFrame, most: int | None = None, held: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parcels (component, group, ...) of the different links (a, b), in groups that hold components whole and have so many links at most, or about; those of components that are larger; and all nodes (node, component, group, n_links). Links that are held are written down already, a < b."""
    most = SMALL if most is None else most
    parcels = parcelled(links if held else ordered(links))
    stars = kept(parcels.select(F.col("least").alias("a"), F.explode("nodes").alias("b")).where("a <> b"))
    label = kept(components(stars, held=True))
    named = kept(parcels.groupBy("least").agg(F.sum("size").alias("size")).join(label.withColumnRenamed("node", "least"), "least"))
    size = named.groupBy("component").agg(F.sum("size").alias("size"))
    minor = F.col("size") <= most // 16
    n = size.where(minor).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Small ones share groups by hash; each of the others has one of its own.
    group = F.when(minor, F.concat(F.lit("#"), F.pmod(F.xxhash64("component"), F.lit(max(1, -(-4 * n // max(1, most))))))).otherwise(F.col("component"))
    size = kept(size.select("component", group.alias("group"), F.col("size").alias("n_links")))
    told = parcels.join(named.select("least", "component").join(size, "component"), "least")
    own = ["component", "group", "nodes", "u", "v", "size"]
    return told.where(F.col("n_links") <= most).select(own), told.where(F.col("n_links") > most).select(own), label.join(size.toDF(*size.columns), "component")


def in_groups(links: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The different links (a, b), with their component and a group that holds components whole and has so many links at most, or about; and the links of components that are larger."""
    groups, large, _ = placed(links, most)
    return links_in(groups), links_in(large).select("a", "b")


def components_by_rounds(links: DataFrame, rounds: int = 200) -> DataFrame:
    both = kept(neighbours(links))
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    before = None
    for _ in range(rounds):
        least = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        spread = label.join(least, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("next"), "component")
        up = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = kept(spread.join(up, F.col("next") == F.col("_n")).select("node", F.least("next", "_c").alias("next"), "component"))
        done = jumped.where("next <> component").isEmpty()
        if before is not None:
            before.unpersist()
        before, label = jumped, jumped.select("node", F.col("next").alias("component"))
        if done:
            both.unpersist()
            return label
    raise RuntimeError("components did not settle")


def described(labels: DataFrame, nodes: DataFrame, links: DataFrame, key: str = "component") -> DataFrame:
    """Each group of nodes (node, key): size, types, the five nodes with most neighbours, and the first of these as its label. nodes: node, name, type_id."""
    told = labels.join(nodes, "node").join(degrees(links), "node", "left").fillna(0, ["degree"])
    types = told.groupBy(key, "type_id").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_id", "n"))), lambda t: F.concat(t["type_id"], F.lit(":"), t["n"])), ",").alias("types"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("degree"), "name", "node"))
    top = told.withColumn("_k", order).where("_k <= 5").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda t: t["name"]), "|").alias("top"), F.min_by("name", "_k").alias("label"))
    return told.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes")).join(types, key).join(top, key)


def cut_vertices(adjacency: dict[str, list[str]]) -> set[str]:
    """Nodes whose removal parts their component, by lowest points of a depth-first walk without recursion."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    cut: set[str] = set()
    for root in adjacency:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children = 0
        stack = [(root, "", iter(adjacency[root]))]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    children += node == root
                    stack.append((other, node, iter(adjacency[other])))
                    break
                if other != parent:
                    low[node] = min(low[node], order[other])
            else:
                stack.pop()
                if parent:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return cut


def spanning_forest(both: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(node, parent, level) of breadth-first trees from the roots, over links in both directions, and how deep they are; a node's parent is its smallest neighbour a level up."""
    levels = [kept(roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))]
    while True:
        seen = reduce(DataFrame.union, [at.select("node") for at in levels[-2:]])  # neighbours are one level apart at most
        ahead = levels[-1].select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        ahead = kept(ahead.join(seen, "node", "left_anti").withColumn("level", F.lit(len(levels))))
        if ahead.isEmpty():
            return kept(reduce(DataFrame.union, levels)), len(levels) - 1
        levels.append(ahead)


def blocks(links: DataFrame) -> DataFrame:
    """(node, parent, block): the links of a spanning forest, and which of them lie in one block (biconnected component), named by one of its nodes.

    A link outside the forest closes a cycle with the paths from its ends up to where they meet,
    and all links on a cycle are in one block. In breadth-first trees the ends are one level
    apart at most. So pairs of nodes of a level rise together, level by level: each pair's
    links are in one block, and as long as the parents differ, so are those above, and the
    parents are a pair in turn. Equal pairs rise as one. Blocks are the components of what was
    found to belong together. There are as many rounds as the trees have levels; no task
    holds more than its share of a level.
    """
    both = kept(neighbours(links))
    tree, depth = spanning_forest(both, components(links).where("node = component").select("node"))
    up = tree.where("parent IS NOT NULL")
    side = lambda k: tree.select(F.col("node").alias(k), F.col("parent").alias(f"above_{k}"), F.col("level").alias(f"level_{k}"))
    outside = both.where("a < b").join(side("a"), "a").join(side("b"), "b").where("NOT (above_a <=> b OR above_b <=> a)")
    pair = lambda x, y: (F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    level = outside.where("level_a = level_b").select(*pair("a", "b"), F.col("level_a").alias("level"))
    deeper = F.col("level_a") > F.col("level_b")
    far, near, above = (F.when(deeper, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"), ("above_a", "above_b")))
    steep = outside.where("level_a <> level_b").select(far.alias("far"), near.alias("near"), above.alias("above"), F.least("level_a", "level_b").alias("level"))
    pairs = kept(level.union(steep.select(*pair("near", "above"), "level")).distinct())
    together = [steep.select("far", "near"), steep.select("far", "above")]
    rising = None
    for at in range(depth, 0, -1):
        now = pairs.where(F.col("level") == at).select("x", "y")
        now = kept(now if rising is None else now.union(rising).distinct())
        rising = None
        if not now.isEmpty():
            above = lambda k: up.select(F.col("node").alias(k), F.col("parent").alias(f"above_{k}"))
            told = kept(now.join(above("x"), "x").join(above("y"), "y").where("above_x <> above_y"))
            together += [now, told.select("x", "above_x"), told.select("y", "above_y")]
            rising = told.select(*pair("above_x", "above_y"))
    named = components(kept(reduce(DataFrame.union, [t.toDF("a", "b") for t in together]).distinct()))
    return up.join(named, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("block"))


def certificate(links: DataFrame) -> DataFrame:
    """At most 2 (n - 1) of the links (a, b) of n nodes, with the same cut vertices and blocks: breadth-first trees of the graph, and those of what they leave over.

    Both are scan-first forests, so that for any one node that is taken out, the parts of the
    graph and of these links are the same.
    """
    both = kept(neighbours(links))
    first, _ = spanning_forest(both, components(links).where("node = component").select("node"))
    tree = first.where("parent IS NOT NULL").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    over = kept(both.join(tree.union(tree.select("b", "a")), ["a", "b"], "left_anti"))
    second, _ = spanning_forest(over, components(over).where("node = component").select("node"))
    return tree.union(second.where("parent IS NOT NULL").select("node", "parent"))


def around_each(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, other): node i of n has the neighbours other[start[i]:start[i + 1]]."""
    left = np.concatenate([u, v])
    order = np.argsort(left, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(left, minlength=n))], np.concatenate([v, u])[order]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The parent of each of n nodes in breadth-first trees from the smallest node of each component, -1 for these."""
    start, other = around_each(u, v, n)
    parent, seen = np.full(n, -1), np.zeros(n, dtype=bool)
    at = np.flatnonzero(least_places(u, v, n) == np.arange(n))
    seen[at] = True
    while len(at):
        degree = start[at + 1] - start[at]
        ahead = other[np.arange(degree.sum()) + np.repeat(start[at] - np.cumsum(degree) + degree, degree)]
        source = np.repeat(at, degree)[~seen[ahead]]
        ahead = ahead[~seen[ahead]]
        parent[ahead] = source
        at = different(ahead)
        seen[at] = True
    return parent


def certified(names: pa.Array | np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of ``certificate``, of one part of a graph.

    Take out any one node, then the links that are picked join what the part's links join. So
    they may stand for these in whatever graph the part is of: its cut vertices stay the same.
    """
    n = len(names)
    left, right = [], []
    for _ in range(2):
        parent = forest(u, v, n)
        child = np.flatnonzero(parent >= 0)
        left.append(np.minimum(child, parent[child]))
        right.append(np.maximum(child, parent[child]))
        rest = (parent[u] != v) & (parent[v] != u)
        u, v = u[rest], v[rest]
    return np.concatenate(left), np.concatenate(right)


def cut_places(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the nodes whose removal parts their component, as ``cut_vertices``, by a walk over what ``certified`` leaves."""
    start, other = (x.tolist() for x in around_each(*certified(np.arange(n), u, v), n))
    rest, order, low, parent = start[:-1], [-1] * n, [0] * n, [-1] * n
    cut = np.zeros(n, dtype=bool)
    count = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = count
        count += 1
        children, node = 0, root
        while node >= 0:
            above = parent[node]
            if rest[node] < start[node + 1]:
                to = other[rest[node]]
                rest[node] += 1
                if order[to] < 0:
                    order[to] = low[to] = count
                    count += 1
                    parent[to] = node
                    children += node == root
                    node = to
                elif to != above and order[to] < low[node]:
                    low[node] = order[to]
            else:
                if above >= 0:
                    low[above] = min(low[above], low[node])
                    if above != root and low[node] >= order[above]:
                        cut[above] = True
                node = above
        cut[root] = children > 1
    return np.flatnonzero(cut)


def block_members(found: DataFrame) -> DataFrame:
    """(block, node): a cut vertex is in several blocks."""
    return found.select("block", "node").union(found.select("block", "parent")).distinct()


def articulation_points(links: DataFrame) -> DataFrame:
    """Nodes whose removal parts their component: those in several blocks; by a walk of each component that a task can hold, once tasks have left out most links of their parts, with the same result."""
    links = ordered(links)  # looked at several times from here on
    if not is_small(links):
        links = thinned(links, True, certified)
    if is_small(links):
        return cut_in_one_task(links)
    groups, large, _ = placed(links, held=True)

    def run(parcels: pa.Table) -> pa.Table:
        names, u, v = unpacked(parcels)
        return pa.table({"node": names.take(pa.array(cut_places(u, v, len(names))))})

    found = groups.groupBy("group").applyInArrow(run, "node string")
    large = kept(links_in(large).select("a", "b"))
    return found if large.isEmpty() else found.union(cut_by_rounds(large))


def cut_in_one_task(links: DataFrame) -> DataFrame:
    """The cut vertices of a graph that was found to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [*batches]
        if parts:
            names, u, v = numbered(parts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(cut_places(u, v, len(names))))], names=["node"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node string")


def cut_by_rounds(links: DataFrame) -> DataFrame:
    """The cut vertices of large components."""
    links = kept(certificate(links))
    if is_small(links):
        return cut_in_one_task(links)
    ends = blocks(links)
    ends = ends.select("node", "block").union(ends.select("parent", "block"))
    return ends.groupBy("node").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first <> last").select("node")


def dependencies(start: np.ndarray, other: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What the shortest paths from each of the sources add to the betweenness of every node, summed over the sources.

    Node i has the neighbours other[start[i]:start[i + 1]], one at least. All sources go
    ahead level by level at once: a row for each node, a column for each source.
    """
    n, k = len(start) - 1, len(sources)
    rows = max(1, 262_144 // k)  # neighbours gathered at a time, to stay in cache
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(start, start[cuts[-1]] + rows, "right")) - 1))

    def around(x: np.ndarray) -> np.ndarray:
        parts = [np.add.reduceat(x[other[start[a] : start[b]]], start[a:b] - start[a], axis=0) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate(parts)

    distance = np.full((n, k), -1, dtype=np.int32)
    paths = np.zeros((n, k))
    distance[sources, np.arange(k)], paths[sources, np.arange(k)] = 0, 1.0
    level = 0
    while True:
        counts = around(np.where(distance == level, paths, 0.0))
        new = (counts > 0) & (distance < 0)
        if not new.any():
            break
        level += 1
        distance[new], paths[new] = level, counts[new]
    share = np.zeros((n, k))
    for at in range(level, 1, -1):
        ahead = np.divide(1 + share, paths, out=np.zeros((n, k)), where=distance == at)
        share += np.where(distance == at - 1, paths * around(ahead), 0.0)
    return share.sum(axis=1)


#: Places of a table of hubs and nodes that a task may hold, and to how many of its places a link is worth a look of its own.
HELD, SPARSE = 25_000_000, 90


def dependencies_by_hubs(u: np.ndarray, v: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray | None:
    """The same as ``dependencies``, of different links u, v, by products with the table of hubs and other nodes; None if that table is large, or not worth it for so few sources.

    Hubs are the ends with more neighbours, so that every link has one and no two others are
    linked. What a hub gets by way of others two steps off comes from the table of hubs that
    have others in common: of these others, only those between the two levels count, and what the
    rest of them adds is where nodes were reached before. Others' own shares are summed over all
    sources as pairs of hubs, as a path through one comes from a hub and goes on to a hub.
    """
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    up = (degree[u] > degree[v]) | ((degree[u] == degree[v]) & (u < v))
    is_hub = np.zeros(n, dtype=bool)
    is_hub[np.where(up, u, v)] = True
    hubs, others = np.flatnonzero(is_hub), np.flatnonzero(~is_hub)
    n_hubs, n_others = len(hubs), len(others)
    if n_hubs * n > min(HELD, 100 * len(u)) or n_hubs * n_hubs * n_others > 400 * len(u) * len(sources):
        return None
    place = np.empty(n, dtype=np.int64)
    place[hubs], place[others] = np.arange(n_hubs), np.arange(n_others)
    both = is_hub[u] & is_hub[v]
    table, among = np.zeros((n_hubs, n_others)), np.zeros((n_hubs, n_hubs))
    among[place[u[both]], place[v[both]]] = among[place[v[both]], place[u[both]]] = 1.0
    x, y = (np.where(is_hub[u], s, t)[~both] for s, t in ((u, v), (v, u)))
    table[place[x], place[y]] = 1.0
    linked = bool(both.any())
    order = np.argsort(place[x], kind="stable")
    start, beside = np.r_[0, np.cumsum(np.bincount(place[x], minlength=n_hubs))], place[y][order]
    shared = table @ table.T
    reach = np.diff(start)

    def listed(hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The others beside some hubs, one after the other, and how many each has."""
        k = reach[hub]
        return beside[np.arange(k.sum()) + np.repeat(start[hub] - np.cumsum(k) + k, k)], k

    def to_others(c: np.ndarray) -> np.ndarray:
        """For each other, the sum over hubs beside it."""
        hub, j = np.nonzero(c)
        if reach[hub].sum() * SPARSE > table.size * c.shape[1]:
            return table.T @ c
        at, k = listed(hub)
        return np.bincount(at * c.shape[1] + np.repeat(j, k), np.repeat(c[hub, j], k), table.shape[1] * c.shape[1]).reshape(-1, c.shape[1]).astype(float)

    def to_hubs(r: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each hub that is wanted, the sum over others beside it."""
        hub, j = np.nonzero(wanted & (reach > 0)[:, None])
        if reach[hub].sum() * SPARSE > table.size * r.shape[1]:
            return table @ r
        out = np.zeros(wanted.shape)
        if len(hub):
            at, k = listed(hub)
            out[hub, j] = np.add.reduceat(r[at, np.repeat(j, k)], np.cumsum(k) - k)
        return out

    share, pairs = np.zeros(n), np.zeros((n_hubs, n_hubs))
    for own in (sources[is_hub[sources]], sources[~is_hub[sources]]):
        for i in range(0, len(own), 64):
            batch = own[i : i + 64]
            k = len(batch)
            left_hubs, left_others = np.ones((n_hubs, k), dtype=bool), np.ones((n_others, k), dtype=bool)
            first = np.zeros((n_hubs, k))
            if is_hub[batch[0]]:
                first[place[batch], np.arange(k)] = 1.0
                left_hubs[place[batch], np.arange(k)] = False
                ahead = among @ first if linked else np.zeros((n_hubs, k))
            else:
                left_others[place[batch], np.arange(k)] = False
                ahead = table[:, place[batch]]
            at_hubs, at_others = [first], [None]  # paths to the hubs and to the others of each level
            while True:
                reached = to_others(at_hubs[-1]) if left_others.any() and at_hubs[-1].any() else None
                if reached is not None:
                    reached[~left_others] = 0.0
                    left_others &= reached == 0
                if len(at_hubs) > 1:
                    ahead = shared @ at_hubs[-2] + (among @ at_hubs[-1] if linked else 0.0)
                ahead = np.where(left_hubs, ahead, 0.0)
                left_hubs &= ahead == 0
                if not ahead.any() and (reached is None or not reached.any()):
                    break
                at_hubs.append(ahead)
                at_others.append(reached)
            after = further = np.zeros((n_hubs, k))  # what the hubs of the next level and of the one after it pass back for each path
            for level in range(len(at_hubs) - 1, -1, -1):
                if level + 2 < len(at_hubs):
                    pairs += at_hubs[level] @ further.T
                if not level:
                    break
                paths = at_hubs[level]
                wanted = paths > 0
                if not wanted.any():
                    after, further = paths, after
                    continue
                back = shared @ further
                if linked:
                    back += among @ after
                if level + 1 < len(at_others) and at_others[level + 1] is not None:
                    r = at_others[level + 1]
                    back += to_hubs(np.divide(1.0, r, out=np.zeros_like(r), where=r > 0), wanted)
                back = np.where(wanted, back * paths, 0.0)
                share[hubs] += back.sum(axis=1)
                after, further = np.divide(1 + back, paths, out=np.zeros_like(paths), where=wanted), after
    for i in range(0, n_others, 1024):  # not all at once, for memory
        part = table[:, i : i + 1024]
        share[others[i : i + 1024]] = (part * (pairs @ part)).sum(axis=0)
    return share


def betweenness(links: DataFrame, sources: int | None = None) -> DataFrame:
    """(node, betweenness), normalised over all nodes; from all sources, or from so many chosen by hash and scaled up.

    A small graph is one task's. Of a larger one, paths stay inside a component: each that a task
    can hold meets its own sources there, dealt out over tasks; larger ones are walked by joins,
    level by level, from all chosen sources at once.
    """
    links = ordered(links)  # looked at several times from here on
    if is_small(links, min(SINGLE, SMALL)):
        return in_one_task(links, lambda adjacency: central(adjacency, sources), "node string, betweenness double")
    return betweenness_by_components(links, sources, held=True)


def central(adjacency: dict[str, list[str]], sources: int | None) -> pd.DataFrame:
    """(node, betweenness) of a whole graph; sources are chosen by a hash of their names."""
    names = list(adjacency)
    n = len(names)
    place = {k: i for i, k in enumerate(names)}
    start = np.cumsum([0, *(len(v) for v in adjacency.values())])
    other = np.array([place[o] for v in adjacency.values() for o in v], dtype=np.int64)
    chosen = range(n) if sources is None or sources >= n else sorted(range(n), key=lambda i: hashlib.sha256(names[i].encode()).digest())[:sources]
    scale = n / max(1, len(chosen)) / max(1, (n - 1) * (n - 2))
    total = np.zeros(n)
    for i in range(0, len(chosen), 64):
        total += dependencies(start, other, np.array(chosen[i : i + 64]))
    return pd.DataFrame({"node": names, "betweenness": np.round(total * scale, 9)})


def structure(links: DataFrame, method: str = "label_propagation") -> DataFrame:
    """(node, degree, component, is_cut, community) of every node that has a link: all in one task if the graph is small, else one after the other."""
    schema = "node string, degree long, component string, is_cut boolean, community string"
    if is_small(links, WALKED):

        def run(adjacency: dict[str, list[str]]) -> pd.DataFrame:
            cut, label = cut_vertices(adjacency), METHODS[method](adjacency)
            least: dict[str, str] = {}
            for node in adjacency:  # in order
                least.setdefault(label[node], node)
            ends = [(k, o) for k, v in adjacency.items() for o in v]
            component = dict(least_reachable(*(np.array(x, dtype=object) for x in zip(*ends, strict=True))).itertuples(index=False))
            return pd.DataFrame([(k, len(v), component[k], k in cut, least[label[k]]) for k, v in adjacency.items()], columns=["node", "degree", "component", "is_cut", "community"])

        return in_one_task(links, run, schema)
    cuts = articulation_points(links).withColumn("is_cut", F.lit(True))
    out = degrees(links).join(components(links), "node").join(cuts, "node", "left").join(communities(links, method), "node")
    return out.select("node", "degree", "component", F.coalesce("is_cut", F.lit(False)).alias("is_cut"), "community")


#: Links times sources that one task walks.
WALK = 2_000_000_000


def betweenness_by_components(links: DataFrame, sources: int | None = None, most: int | None = None, held: bool = False) -> DataFrame:
    groups, large, nodes = placed(links, most, held)
    nodes = kept(nodes)
    n = nodes.count()
    chosen = nodes if sources is None or sources >= n else kept(nodes.orderBy(F.sha2("node", 256)).limit(sources))
    scale = (n / sources if sources and sources < n else 1.0) / max(1, (n - 1) * (n - 2))
    size = groups.groupBy("group").agg(F.sum("size").alias("n_links")).join(chosen.groupBy("group").agg(F.count(F.lit(1)).alias("n_asking")), "group")
    parts = kept(size.select("group", F.ceil(F.col("n_links") * F.col("n_asking") / WALK).alias("parts")))
    sent = groups.select("nodes", "u", "v", "size", "group").join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = chosen.join(parts, "group").select("node", "group", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    n_tasks = parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]

    def run(parcels: pa.Table, asks: pa.Table) -> pa.Table:
        names, u, v = unpacked(parcels) if parcels.num_rows else (pa.array([], pa.string()), np.zeros(0), np.zeros(0))
        asked = pc.index_in(asks["node"], names).drop_null().to_numpy()
        if not len(names) or not len(asked):
            return pa.table({"node": pa.array([], pa.string()), "share": pa.array([], pa.float64())})
        share = dependencies_by_hubs(u, v, len(names), asked)
        if share is None:
            start, other = around_each(u, v, len(names))
            share = sum(dependencies(start, other, asked[i : i + 32]) for i in range(0, len(asked), 32))
        return pa.table({"node": names, "share": share})

    # Their work is their links times sources, however few bytes these are: a part is not put with others because it is small.
    own = lambda df: df.repartition(max(1, min(10_000, 3 * n_tasks)), "group", "part").groupBy("group", "part")
    total = own(sent.select("group", "part", "nodes", "u", "v", "size")).cogroup(own(dealt)).applyInArrow(run, "node string, share double")
    if not large.isEmpty():
        both = kept(neighbours(links_in(large)))
        total = total.union(dependencies_by_joins(both, chosen.select("node").join(both.select(F.col("a").alias("node")), "node", "left_semi")))
    summed = total.groupBy("node").agg((F.sum("share") * scale).alias("betweenness"))
    return nodes.select("node").join(summed, "node", "left").select("node", F.round(F.coalesce("betweenness", F.lit(0.0)), 9).alias("betweenness"))


def dependencies_by_joins(both: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, share): what the shortest paths from each chosen node (node) add, in parts."""
    levels = [kept(chosen.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
    reached = levels[0].select("s", "node")
    while True:
        ahead = levels[-1].join(both, F.col("node") == F.col("a")).groupBy("s", "b").agg(F.sum("paths").alias("paths")).withColumnRenamed("b", "node")
        ahead = kept(ahead.join(reached, ["s", "node"], "left_anti"))
        if ahead.isEmpty():
            break
        levels.append(ahead)
        reached = levels[-1].select("s", "node").union(levels[-2].select("s", "node"))  # neighbours are one level apart at most
    total, share = None, None
    for level in range(len(levels) - 1, 0, -1):
        own = levels[level] if share is None else levels[level].join(share, ["s", "node"], "left")
        own = own.withColumn("share", F.lit(0.0) if share is None else F.coalesce("share", F.lit(0.0)))
        part = own.select("node", "share")
        total = part if total is None else total.union(part)
        up = own.select("s", "node", ((1 + F.col("share")) / F.col("paths")).alias("each")).join(both, F.col("node") == F.col("b")).select("s", F.col("a").alias("node"), "each")
        share = kept(up.join(levels[level - 1], ["s", "node"]).groupBy("s", "node").agg((F.sum("each") * F.first("paths")).alias("share")))
    return both.sparkSession.createDataFrame([], "node string, share double") if total is None else total


def betweenness_by_joins(links: DataFrame, sources: int | None = None) -> DataFrame:
    return betweenness_by_components(links, sources, 0)


def propagated(adjacency: dict[str, list[str]]) -> dict[str, str]:
    """Label propagation until nothing changes: every change puts more links inside a community, so it ends."""
    label = {k: k for k in adjacency}
    changed = True
    while changed:
        changed = False
        for node in adjacency:
            counts: dict[str, int] = {}
            for other in adjacency[node]:
                counts[label[other]] = counts.get(label[other], 0) + 1
            most = max(counts.values())
            best = {k for k, v in counts.items() if v == most}
            if label[node] not in best:
                label[node], changed = min(best), True
    return label


def louvain(adjacency: dict[str, list[str]]) -> dict[str, str]:
    """Communities by greedy modularity: nodes move to the neighbouring community that gains most, then communities become nodes, until none moves."""
    return louvain_of({k: {o: 1.0 for o in v} for k, v in adjacency.items()})


def louvain_of(weights: dict[str, dict[str, float]], total: float | None = None) -> dict[str, str]:
    """The same of links with weights, told from both ends; a node's link to itself counts what is inside it twice. A part of a graph is given the total of all weights."""
    belongs = {k: k for k in weights}
    total = sum(sum(w.values()) for w in weights.values()) if total is None else total
    while True:
        label = {k: k for k in weights}
        degree = {k: sum(w.values()) for k, w in weights.items()}
        held = dict(degree)  # the sum of degrees in each community
        moved, any_moved = True, False
        while moved:
            moved = False
            for node, around in weights.items():
                own = label[node]
                to: dict[str, float] = {}
                for other, w in around.items():
                    if other != node:
                        to[label[other]] = to.get(label[other], 0.0) + w
                held[own] -= degree[node]
                gain = lambda c: to.get(c, 0.0) - degree[node] * held[c] / total  # noqa: B023, E731
                best = max(sorted({own, *to}), key=lambda c: (round(gain(c), 9), c == own))
                held[best] += degree[node]
                if best != own:
                    label[node], moved, any_moved = best, True, True
        if not any_moved:
            return belongs
        belongs = {k: label[c] for k, c in belongs.items()}
        grouped: dict[str, dict[str, float]] = {}
        for node, around in weights.items():
            mine = grouped.setdefault(label[node], {})
            for other, w in around.items():
                mine[label[other]] = mine.get(label[other], 0.0) + w
        weights = grouped


def moved(weights: DataFrame, total: float, rounds: int) -> tuple[DataFrame, float]:
    """(node, community) after nodes have moved between communities for some rounds, and its modularity.

    weights: a, b, w, from both ends. In each round every node finds the neighbouring community
    that gains most, by the links there and the sums of degrees, and half of the nodes, by hash,
    move; of two single nodes only the larger moves to the smaller. So neighbours rarely change
    places, and the best state seen is kept.
    """
    label = kept(weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d")).withColumn("community", F.col("node")))
    loops = weights.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    best, best_q, flat = label, -2.0, 0
    for step in range(rounds):
        held = label.groupBy("community").agg(F.sum("d").alias("sum"), F.count(F.lit(1)).alias("size"))
        to = weights.where("a <> b").join(label.select(F.col("node").alias("b"), F.col("community").alias("to")).hint("merge"), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("k"))
        own = label.join(held.hint("merge"), "community")
        offers = to.join(held.toDF("to", "to_sum", "to_size").hint("merge"), "to").join(own.hint("merge"), "node")
        gain = F.round(F.col("k") - F.col("d") * F.col("to_sum") / total, 9)
        inside = F.max(F.when(F.col("to") == F.col("community"), F.col("k")))
        other = F.max(F.when(F.col("to") != F.col("community"), F.struct(gain.alias("gain"), "to", "to_size")))
        each = own.join(offers.groupBy("node").agg(inside.alias("inside"), other.alias("best")).hint("merge"), "node", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
        stay = F.col("inside") - F.col("d") * (F.col("sum") - F.col("d")) / total
        alone = (F.col("size") == 1) & (F.col("best.to_size") == 1) & (F.col("best.to") > F.col("community"))
        wants = F.coalesce((F.col("best.gain") > stay + 1e-7) & ~alone, F.lit(False))
        told = kept(each.withColumn("wants", wants))
        found = told.agg(F.sum("inside"), F.sum(F.col("d") * F.col("sum")), F.count_if("wants")).first()
        q = ((found[0] or 0.0) + loops) / total - (found[1] or 0.0) / total**2
        flat = 0 if q > best_q + 1e-3 else flat + 1
        if q > best_q:
            best, best_q = label, q
        if not found[2] or flat > 2:
            break
        goes = F.col("wants") & (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0)
        label = kept(told.select("node", "d", F.when(goes, F.col("best.to")).otherwise(F.col("community")).alias("community")))
    return best.select("node", "community"), best_q


def modular_by_rounds(links: DataFrame, rounds: int = 16, total: float | None = None) -> DataFrame:
    """(node, community) by greedy modularity: ``moved``, then communities become nodes, until they gain no more or the graph they make is small enough to walk. A part of a graph is given the total of all weights.

    What grows with the nodes meets by sorted merge: files tell too little of its size, and a broadcast each round passes the driver.
    """
    weights = kept(neighbours(links).withColumn("w", F.lit(1.0)))
    total = float(weights.count()) if total is None else total
    if not total:
        return weights.select(F.col("a").alias("node"), F.col("b").alias("community"))
    belongs, last = None, -2.0
    while True:
        labels, q = moved(weights, total, rounds)
        if q <= last + 1e-5:
            break
        last = q
        belongs = kept(labels if belongs is None else belongs.join(labels.toDF("community", "next").hint("merge"), "community").select("node", F.col("next").alias("community")))
        ends = weights.join(labels.toDF("a", "x").hint("merge"), "a").join(labels.toDF("b", "y").hint("merge"), "b")
        weights = kept(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
        if is_small(weights, WALKED):
            break
    if is_small(weights, WALKED):

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, dict[str, float]] = {}
            for batch in batches:
                for a, b, w in zip(batch["a"], batch["b"], batch["w"], strict=True):
                    held.setdefault(a, {})[b] = w
            found = louvain_of({k: held[k] for k in sorted(held)}, total)
            yield pd.DataFrame({"community": list(found), "next": list(found.values())}, dtype=object)

        further = weights.coalesce(1).mapInPandas(walk, "community string, next string")
        belongs = belongs.join(further.hint("merge"), "community").select("node", F.col("next").alias("community"))
    return belongs


def propagated_by_rounds(links: DataFrame, rounds: int = 50, total: float | None = None) -> DataFrame:
    """(node, community) by label propagation in which half of the nodes, by hash, take the most frequent label around in each round, the smallest of equals, and keep their own if it is among them."""
    both = kept(neighbours(links))
    label = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for step in range(rounds):
        around = both.join(label.toDF("b", "to").hint("merge"), "b").groupBy(F.col("a").alias("node"), "to").agg(F.count(F.lit(1)).alias("k"))
        counted = around.join(label.hint("merge"), "node").groupBy("node", "community").agg(F.max("k").alias("most"), F.max(F.when(F.col("to") == F.col("community"), F.col("k"))).alias("own"), F.min(F.struct((-F.col("k")).alias("k"), "to")).alias("best"))
        told = kept(counted.withColumn("wants", ~F.col("own").eqNullSafe(F.col("most"))))
        if told.where("wants").isEmpty():
            break
        goes = F.col("wants") & (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0)
        label = told.select("node", F.when(goes, F.col("best.to")).otherwise(F.col("community")).alias("community"))
    return label


def sums_of(u: np.ndarray, to: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of u and to, both under n, in order, and the sum of w of each."""
    key = u * n + to
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first) if len(first) else w[:0]


def propagated_in_arrays(u: np.ndarray, v: np.ndarray, goes: np.ndarray, total: float, walked: int, rounds: int = 50) -> np.ndarray:
    """The rounds of ``propagated_by_rounds`` over links u, v told from both ends, of nodes by number in order of their names; bit k of goes says which nodes may move in round k."""
    n = len(goes)
    label = np.arange(n)
    for step in range(rounds):
        there = np.flatnonzero(np.bincount(label, minlength=n))
        if n * len(there) <= 4 * len(u):  # few labels are left: a table of nodes and labels
            code = np.searchsorted(there, label)
            k = np.bincount(u * len(there) + code[v], minlength=n * len(there)).reshape(n, -1)
            most, own, best = k.max(axis=1), k[np.arange(n), code], there[k.argmax(axis=1)]
        else:
            key = np.sort(u * n + label[v])
            first = np.flatnonzero(np.diff(key, prepend=-1))
            k, node, to = np.diff(np.append(first, len(key))), key[first] // n, key[first] % n
            most = np.maximum.reduceat(k, np.flatnonzero(np.diff(node, prepend=-1)))
            own = np.zeros(n, dtype=k.dtype)
            mine = to == label[node]
            own[node[mine]] = k[mine]
            node, to = node[k == most[node]], to[k == most[node]]
            best = to[np.flatnonzero(np.diff(node, prepend=-1))]
        wants = own != most
        if not wants.any():
            break
        label = np.where(wants & (goes >> step & 1 == 1), best, label)
    return label


def moved_in_arrays(u: np.ndarray, v: np.ndarray, w: np.ndarray, goes: np.ndarray, total: float, rounds: int) -> tuple[np.ndarray, float]:
    """The rounds of ``moved`` over arrays."""
    n = len(goes)
    d = np.bincount(u, w, n)
    apart = u != v
    loops, (u, v, w) = w[~apart].sum(), (u[apart], v[apart], w[apart])
    label = np.arange(n)
    best, best_q, flat = label, -2.0, 0
    for step in range(rounds):
        held, size = np.bincount(label, d, n), np.bincount(label, minlength=n)
        node, to, k = sums_of(u, label[v], w, n)
        mine = to == label[node]
        inside = np.zeros(n)
        inside[node[mine]] = k[mine]
        node, to, k = node[~mine], to[~mine], k[~mine]
        gain = np.round(k - d[node] * held[to] / total, 9)
        offer, where = np.full(n, -np.inf), label.copy()
        if len(node):
            first = np.flatnonzero(np.diff(node, prepend=-1))
            offer[node[first]] = np.maximum.reduceat(gain, first)
            where[node[gain == offer[node]]] = to[gain == offer[node]]  # of equals the last, which is the largest
        stay = inside - d * (held[label] - d) / total
        alone = (size[label] == 1) & (size[where] == 1) & (where > label)
        wants = (offer > stay + 1e-7) & ~alone
        q = (inside.sum() + loops) / total - (d * held[label]).sum() / total**2
        flat = 0 if q > best_q + 1e-3 else flat + 1
        if q > best_q:
            best, best_q = label, q
        if not wants.any() or flat > 2:
            break
        label = np.where(wants & (goes >> step & 1 == 1), where, label)
    return best, best_q


def modular_in_arrays(u: np.ndarray, v: np.ndarray, goes: np.ndarray, total: float, walked: int, rounds: int = 16) -> np.ndarray:
    """The rounds of ``modular_by_rounds`` over arrays; what has so many links at most is walked."""
    n, w = len(goes), np.ones(len(u))
    belongs, last = np.arange(n), -2.0
    while True:
        label, q = moved_in_arrays(u, v, w, goes, total, rounds)
        if q <= last + 1e-5:
            break
        last, belongs = q, label[belongs]
        u, v, w = sums_of(label[u], label[v], w, n)
        if len(u) <= walked:
            break
    if len(u) <= walked:
        held: dict[int, dict[int, float]] = {}
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
            held.setdefault(a, {})[b] = x
        further = np.arange(n)
        found = louvain_of(held, total)
        further[list(found)] = list(found.values())
        belongs = further[belongs]
    return belongs


def rounds_apart(parcels: DataFrame, nodes: DataFrame, method: str, total: float) -> DataFrame:
    """(node, community), named by its smallest node, of parcels in groups that hold components whole, and their nodes (group, node): the rounds of a group are one task's, over arrays."""
    find, steps = IN_ARRAYS[method]
    n = parcels.select("group").distinct().count()
    goes = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(1 - F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)), k) for k in range(steps)])
    nodes = nodes.select("group", "node", goes.alias("goes"))

    walked = WALKED

    def run(parcels: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        names, u, v = unpacked(parcels)
        label = find(np.concatenate([u, v]), np.concatenate([v, u]), nodes["goes"].to_numpy(), total, walked)
        least = np.full(len(names), len(names))
        np.minimum.at(least, label, np.arange(len(names)))
        return pa.table({"node": names, "community": names.take(pa.array(least[label]))})

    # Their work is their links, however few bytes these are: a group is not put with others because it is small.
    dealt = lambda df: df.repartition(max(1, n), "group").groupBy("group")
    return dealt(parcels.select("group", "nodes", "u", "v", "size")).cogroup(dealt(nodes)).applyInArrow(run, "node string, community string")


METHODS = {"label_propagation": propagated, "louvain": louvain}
BY_ROUNDS = {"label_propagation": propagated_by_rounds, "louvain": modular_by_rounds}
#: The same rounds over arrays, and how many there are at most.
IN_ARRAYS = {"label_propagation": (propagated_in_arrays, 50), "louvain": (modular_in_arrays, 16)}


def communities(links: DataFrame, method: str = "label_propagation") -> DataFrame:
    """(node, community), named by its smallest node; by label propagation (the most frequent label around, the smallest of equals, keeping one's own if among them) or greedy modularity.

    Both are heuristics. A small graph is walked by one task, node by node; a larger one goes by
    rounds, in which many nodes move at once, so that its partition may be another of like modularity.
    Rounds look at nothing outside a component, but for the sum of all links: components that a task
    holds have theirs over arrays, each apart, and only larger ones go by joins.
    """
    find = METHODS[method]
    links = ordered(links)  # looked at several times from here on
    if not is_small(links, WALKED):
        if is_small(links):
            own = parcelled(links)
            n = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            nodes = own.select(F.explode("nodes").alias("node")).distinct()
            return rounds_apart(own.withColumn("group", F.lit("")), nodes.withColumn("group", F.lit("")), method, 2.0 * n)
        groups, large, nodes = placed(links, held=True)
        large = kept(links_in(large).select("a", "b"))
        n_large = large.count()
        total = 2.0 * (groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] + n_large)
        found = rounds_apart(groups, nodes.where(F.col("n_links") <= SMALL), method, total)
        if not n_large:
            return found
        joined = kept(BY_ROUNDS[method](large, total=total))
        least = joined.groupBy("community").agg(F.min("node").alias("least")).hint("merge")
        return found.union(joined.join(least, "community").select("node", F.col("least").alias("community")))

    def run(adjacency: dict[str, list[str]]) -> pd.DataFrame:
        label = find(adjacency)
        least: dict[str, str] = {}
        for node in sorted(label):
            least.setdefault(label[node], node)
        return pd.DataFrame({"node": list(label), "community": [least[c] for c in label.values()]}, dtype=object)

    return in_one_task(links, run, "node string, community string")


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (node, community), with how it reads."""
    both = neighbours(links)
    own = labels.select("node", "community")
    sides = both.join(own.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(own.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = sides.groupBy("ca").agg(F.count(F.lit(1)).alias("ends"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    total = F.sum("ends")
    score = F.round(F.sum("inside") / total - F.sum(F.col("ends") * F.col("ends")) / (total * total), 4)
    return ends.agg(score.alias("modularity"), F.count(F.lit(1)).alias("n_communities")).withColumn("reading", F.when(F.col("modularity") >= 0.3, "strong").otherwise("weak"))


def bridges(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, community, n_communities, n_links): nodes with neighbours in other communities than their own."""
    own = labels.select("node", "community")
    sides = neighbours(links).join(own.select(F.col("node").alias("a"), "community"), "a").join(own.select(F.col("node").alias("b"), F.col("community").alias("other")), "b")
    out = sides.where("community <> other").groupBy(F.col("a").alias("node"), "community")
    return out.agg(F.count_distinct("other").alias("n_communities"), F.count(F.lit(1)).alias("n_links"))


def connections(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(left, right, n_links): links between each two communities that have any."""
    own = labels.select("node", "community")
    undirected = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    sides = undirected.join(own.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
    return sides.where("x <> y").groupBy(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).agg(F.count(F.lit(1)).alias("n_links"))


def unconnected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: communities, pairs of them, pairs with a link, and pairs without any, by arithmetic."""
    n = labels.agg(F.count_distinct("community").alias("n_communities"))
    touching = connections(links, labels).agg(F.count(F.lit(1)).alias("n_touching"))
    out = n.crossJoin(touching)  # two single rows
    pairs = F.expr("n_communities * (n_communities - 1) div 2")
    return out.select("n_communities", pairs.alias("n_pairs"), "n_touching", (pairs - F.col("n_touching")).alias("n_apart"))


def capped(rows: DataFrame, cap: int, *order) -> DataFrame:
    """The first rows of a list, each with the number of all."""
    total = rows.agg(F.count(F.lit(1)).alias("n_total"))
    return rows.orderBy(*order).limit(cap).crossJoin(F.broadcast(total))  # one row


def topology(links: DataFrame, nodes: DataFrame, cap: int = 20, method: str = "louvain", exact: bool = False) -> dict[str, DataFrame]:
    """Everything about a graph's shape as named tables, lists cut at ``cap`` rows with their totals."""
    labels = kept(communities(links, method))
    joined = components(links)
    rank = betweenness(links, None if exact else 100)
    return {
        "components": capped(described(joined, nodes, links), cap, F.desc("n_nodes"), "component"),
        "cut_vertices": capped(articulation_points(links).join(degrees(links), "node"), cap, F.desc("degree"), "node"),
        "isolates": capped(isolates(nodes.select("node"), links), cap, "node"),
        "degree": capped(degrees(links), cap, F.desc("degree"), "node"),
        "betweenness": capped(rank, cap, F.desc("betweenness"), "node"),
        "communities": capped(described(labels.select("node", "community"), nodes, links, "community"), cap, F.desc("n_nodes"), "community"),
        "modularity": modularity(links, labels),
        "bridges": capped(bridges(links, labels), cap, F.desc("n_communities"), F.desc("n_links"), "node"),
        "connections": capped(connections(links, labels), cap, "n_links", "left", "right"),
        "unconnected": unconnected(links, labels),
    }


def neighbourhood(links: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(node, hops) within so many hops of a page."""
    # Both ways, repeats and loops included: what is reached is told once anyway.
    both = links.select("a", "b").union(links.select("b", "a"))
    reached = links.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    edge = reached
    for hop in range(1, depth + 1):
        found = edge.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(hop).alias("hops"))
        # Written at each hop, so that few nodes are known to be few and links need no shuffle to meet them.
        edge = kept(found.distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(edge)
    return reached


def paths_between(links: DataFrame, start: str, end: str, most: int = 6, paths: int | None = None) -> DataFrame:
    """(path, length): simple paths of at most so many hops; walks from both ends meet half way.

    All of them, or the first ``paths`` by length and nodes: then no longer ones are looked for
    once the shorter are enough, so that hubs far off cost nothing.
    """
    both = kept(neighbours(links))
    spark = links.sparkSession

    def walk(node: str) -> list[DataFrame]:
        return [spark.createDataFrame([([node], node)], "path array<string>, at string")]

    def further(walks: list[DataFrame], hops: int) -> DataFrame:
        while len(walks) <= hops:
            on = walks[-1].join(both, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")))
            # Written, so that few walks are known to be few and links need no shuffle to meet them.
            walks.append(kept(on.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"))))
        return walks[hops]

    ahead, back = walk(start), walk(end)
    out, n = None, 0
    for hops in range(1, most + 1):
        rest = further(back, hops // 2).select("at", F.col("path").alias("rest"))
        met = further(ahead, (hops + 1) // 2).join(rest, "at").where(F.size(F.array_intersect("path", "rest")) == 1)
        found = met.select(F.concat("path", F.slice(F.reverse("rest"), 2, most)).alias("path"))
        if paths is not None:
            found = kept(found.orderBy("path").limit(paths))
            n += found.count()
        out = found if out is None else out.union(found)
        if paths is not None and n >= paths:
            break
    out = out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("length"))
    return out if paths is None else first_paths(out, paths)


def first_paths(paths: DataFrame, n: int = 5) -> DataFrame:
    """The shortest paths, equal ones in the order of their nodes."""
    return paths.orderBy("length", F.split("path", ">")).limit(n)


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """(nodes, path, length) of directed cycles of 2 to so many nodes, one a set of nodes: the least path from its smallest node."""
    edge = edges.select("a", "b").where("a <> b").distinct()
    walk = edge.where("a < b").select(F.array("a", "b").alias("path"))
    found = None
    for length in range(2, most + 1):
        ends = walk.select("path", F.get("path", F.lit(length - 1)).alias("a"), F.get("path", F.lit(0)).alias("b"))
        closed = ends.join(edge, ["a", "b"], "left_semi").groupBy(F.array_join(F.array_sort("path"), ",").alias("nodes")).agg(F.min("path").alias("path"))
        closed = closed.select("nodes", F.array_join("path", ">").alias("path"), F.lit(length).cast("long").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        on = ends.select("path", "a").join(edge, "a").where((F.col("b") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("b")))
        walk = on.select(F.concat("path", F.array("b")).alias("path"))
    return found


def induced(links: DataFrame, reached: DataFrame) -> DataFrame:
    """(a, b): the links among nodes that were reached."""
    held = links.select("a", "b").where("a <> b").join(reached.select(F.col("node").alias("a")), "a", "left_semi").join(reached.select(F.col("node").alias("b")), "b", "left_semi")
    return held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def triangles(links: DataFrame) -> DataFrame:
    """(x, y, z): every three nodes that are linked with each other.

    Links point from the node with fewer neighbours, so that a hub has few that leave it. A third
    node is looked for among those that leave the one end of a link which has fewer of them.
    """
    once = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    degree = once.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = once.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    forth = F.expr("da < db OR (da = db AND a < b)")
    ahead = kept(ranked.select(F.when(forth, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(forth, F.col("b")).otherwise(F.col("a")).alias("b")))
    leaving = ahead.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    # A link whose far end nothing leaves is in no triangle as its first link.
    told = ahead.join(leaving.toDF("b", "nb"), "b").join(leaving.toDF("a", "na"), "a")
    near = F.col("na") < F.col("nb")
    asked = told.select("a", "b", F.when(near, F.col("a")).otherwise(F.col("b")).alias("via"), F.when(near, F.col("b")).otherwise(F.col("a")).alias("other"))
    wedges = asked.join(ahead.toDF("via", "z"), "via").where("z <> b")
    found = wedges.join(ahead.toDF("other", "z"), ["other", "z"], "left_semi")
    return found.select(F.col("a").alias("x"), F.least("b", "z").alias("y"), F.greatest("b", "z").alias("z"))


def shared_neighbours(links: DataFrame) -> DataFrame:
    """(via, n_pairs): per cut vertex, how many pairs of its neighbours aren't related themselves; all pairs by arithmetic, less the triangles that it is in."""
    links = kept(links.select("a", "b"))  # looked at several times from here on
    cut = kept(articulation_points(links))
    both = neighbours(links)
    beside = kept(both.join(cut.toDF("a"), "a", "left_semi"))
    # A triangle that a cut vertex is in has its other two nodes beside it.
    about = kept(cut.union(beside.select("b")).distinct())
    corners = triangles(induced(links, about)).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    own = beside.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).join(corners, "node", "left")
    pairs = F.expr("degree * (degree - 1) div 2") - F.coalesce("n", F.lit(0))
    return own.select(F.col("node").alias("via"), pairs.alias("n_pairs")).where("n_pairs > 0")


def person_bridges(links: DataFrame, types: DataFrame, person: str = "Person") -> DataFrame:
    """(person, a, b): persons next to two others than persons that are related themselves; the pairs come from the links between these, never from a person's neighbours."""
    told = types.select("node", (F.col("type_id") == person).alias("is_person"))
    undirected = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    typed = undirected.join(told.select(F.col("node").alias("a"), F.col("is_person").alias("pa")), "a").join(told.select(F.col("node").alias("b"), F.col("is_person").alias("pb")), "b")
    dealing = typed.where("NOT pa AND NOT pb").select("a", "b")
    beside = typed.where("pa <> pb").select(F.when(F.col("pa"), F.col("a")).otherwise(F.col("b")).alias("person"), F.when(F.col("pa"), F.col("b")).otherwise(F.col("a")).alias("side"))
    first = dealing.join(beside.select("person", F.col("side").alias("a")), "a")
    return first.join(beside.select("person", F.col("side").alias("b")), ["person", "b"], "left_semi").select("person", "a", "b")


def best_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (path, length) with their hops' best edges by (n_confirmed, n_documents): whether all are confirmed, and the weakest hop's documents. edges: from_page, to_page, n_confirmed, n_documents."""
    undirected = edges.select(F.least("from_page", "to_page").alias("x"), F.greatest("from_page", "to_page").alias("y"), "n_confirmed", "n_documents")
    best = undirected.groupBy("x", "y").agg(F.max(F.struct("n_confirmed", "n_documents")).alias("e"))
    nodes = F.split("path", ">")
    hops = paths.select("path", "length", F.explode(F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda i: F.struct(F.get(nodes, i).alias("f"), F.get(nodes, i + 1).alias("t")))).alias("h"))
    told = hops.select("path", "length", F.least("h.f", "h.t").alias("x"), F.greatest("h.f", "h.t").alias("y")).join(best, ["x", "y"])
    return told.groupBy("path", "length").agg(F.bool_and(F.col("e.n_confirmed") > 0).alias("confirmed_throughout"), F.min("e.n_documents").alias("weakest_documents"))
