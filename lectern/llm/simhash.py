"""Operator 9: SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits. The anchors are the codewords of a covering code: the product of
two binary Golay codes, on bits 0-22 and 23-45, each of which covers its 23 bits with radius
3. Every fingerprint has one home anchor, within the covering radius in both halves. It is
also replicated to every anchor that its halves exceed the radius to by ``threshold`` in
total at most: if x and y differ in no more bits than that, y reaches x's home. Only there
are the two compared, on all 64 bits, so no link is missed. About 61 replicas a fingerprint
are made, over 2^24 anchors. Copies share one fingerprint, which is compared once.

Within an anchor the links are reduced to a spanning forest. An anchor of many fingerprints
is not compared pair by pair: two fingerprints within two bits share a word that is within
one bit of both, so members are linked by these words, 65 each.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and
link like any other. A text of one or two words has one shingle, its words. A null doc_id is
fingerprinted and gets the component's smallest doc_id, or null if no member has one;
``survivors`` keeps such rows. Rows that repeat a doc_id are fingerprinted one by one, and texts
that are not near each other stay apart. An empty table gives no rows. Only ``doc_id`` and
``text`` are looked at; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, components, map_texts, materialise, partitions, remove, runs, salted_join, unboxed, written_path

WORDS = 3
SEED = 42
THRESHOLD = 2
#: Length, radius and generator polynomial of the binary Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b101011100011
#: An anchor with more members than this is linked by shared words instead of pairs.
MANY = 1500


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns beside the text, and fp: the fingerprint as a signed 64-bit number."""
    make = lambda texts: {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}
    return map_texts(docs, "text", make, "fp long", [c for c in docs.columns if c != "text"])


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator polynomial."""
    words = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    return words


@cache
def offsets(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of weight up to radius + threshold sorted by syndrome: the words, their excess over the radius, and where each syndrome begins."""
    words, excess = [], []
    for weight in range(RADIUS + threshold + 1):
        found = [sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)]
        words += found
        excess += [max(0, weight - RADIUS)] * len(found)
    w, e = np.array(words, dtype=np.int64), np.array(excess, dtype=np.int64)
    s = syndrome(w)
    order = np.lexsort((e, s))
    return w[order], e[order], np.searchsorted(s[order], np.arange(2049))


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges begin to end: the number of the range, and each place in it."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def anchors(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (index, anchor, home) of every anchor that each is sent to."""
    words, excess, first = offsets(threshold)
    halves = []
    for shift in (0, LENGTH):
        half = ((fp >> np.uint64(shift)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        s = syndrome(half)
        owner, at = spread(first[s], first[s + 1])
        # A codeword is known by its upper 12 bits: the code is cyclic, so these determine the rest.
        halves.append((owner, (half[owner] ^ words[at]) >> 11, excess[at]))
    (o1, a1, e1), (o2, a2, e2) = halves
    begin2 = np.searchsorted(o2, np.arange(len(fp) + 1))
    row, at = spread(begin2[o1], begin2[o1 + 1])
    near = e1[row] + e2[at] <= threshold
    row, at = row[near], at[near]
    home = (e1[row] + e2[at]) == 0
    return o1[row], (a1[row] << 12) | a2[at], home


def replicate(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for i in range(0, len(fp), 4000):
                part = fp[i : i + 4000]
                index, anchor, home = anchors(part.view(np.uint64))
                yield pd.DataFrame({"anchor": anchor.astype(np.int32), "fp": part[index], "home": home})

    return distinct.mapInPandas(run, "anchor int, fp long, home boolean")


def linked(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links over distinct words that join exactly what is within two bits, without comparing pairs: by shared words within one bit."""
    if threshold != 2:
        raise ValueError("shared words are those of threshold 2")
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    u, v = [], []
    passes = max(1, len(fp) * 65 >> 22)
    for p in range(passes):
        places, shared = [], []
        for i in range(0, len(fp), 1 << 15):
            words = fp[i : i + (1 << 15), None] ^ flips
            row, col = np.nonzero((words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == p)
            places.append(row + i)
            shared.append(words[row, col])
        at, words = np.concatenate(places), np.concatenate(shared)
        order = np.argsort(words, kind="stable")
        at, words = at[order], words[order]
        same = words[1:] == words[:-1]
        u.append(at[:-1][same])
        v.append(at[1:][same])
    return np.concatenate(u), np.concatenate(v)


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of fingerprints that form a spanning forest of the links found at each anchor."""
    order = np.lexsort((~home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    end = np.r_[begin[1:], len(anchor)]
    homes = np.add.reduceat(home.astype(np.int64), begin)
    u, v = [], []
    busy = (homes > 0) & (end - begin > 1)
    many = busy & (end - begin > MANY)
    for b, e in zip(begin[many], end[many], strict=True):
        x, y = linked(fp[b:e], threshold)
        u.append(x + b)
        v.append(y + b)
    few = np.flatnonzero(busy & ~many)
    cost = np.cumsum(homes[few] * (end - begin)[few])
    for group in np.split(few, np.searchsorted(cost, np.arange(1 << 21, cost[-1] if len(cost) else 0, 1 << 21))):
        owner, at = spread(begin[group], begin[group] + homes[group])
        row, other = spread(begin[group][owner], end[group][owner])
        close = (np.bitwise_count(fp[at[row]] ^ fp[other]) <= threshold) & (at[row] < other)
        u.append(at[row][close])
        v.append(other[close])
    if not u or not sum(map(len, u)):
        return fp[:0], fp[:0]
    x, y = np.concatenate(u), np.concatenate(v)
    nodes, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    root = components(back[: len(x)], back[len(x) :], len(nodes))
    loose = root != np.arange(len(nodes))
    return fp[nodes[root[loose]]], fp[nodes[loose]]


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between different fingerprints whose components are those of all links within the threshold."""
    n = partitions(distinct.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, "anchor", 200_000):
            a, b = compare(frame["anchor"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy())
            yield pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    return replicate(distinct).repartition(n, "anchor").sortWithinPartitions("anchor").mapInPandas(run, "u long, v long").distinct()


def connected(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star rounds until nothing changes."""
    ordered = lambda df: df.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialise(ordered(pairs), "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ordered(both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = ordered(large.join(least, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).union(least.select(F.col("m").alias("u"), "v")))
        after = materialise(small, "links")
        # A forest of stars whose centres are nobody's leaf stays as it is.
        done = after.select("u").distinct().join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and after.groupBy("v").count().where("count > 1").isEmpty()
        remove(edges.sparkSession, [written_path(edges)])  # nothing reads it again
        edges = after
        if done:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError("components did not settle")


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, fp, root, component_id) per row of docs; sig is a hash of the text."""
    prints = materialise(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = connected(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialise(rooted.join(smallest, "root").select("fp", "n", "root", "component_id"), "components")
    return salted_join(prints, by_print, ["fp"], "n", prints.count()).select("doc_id", "sig", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return components_of(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, then of the smallest hash of its text, then the first as JSON; rows without a doc_id stay."""
    same = components_of(docs).where("doc_id IS NOT NULL").groupBy("root", "doc_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    kept = same.groupBy("root").agg(F.min(F.struct("doc_id", "sig", "n")).alias("k")).select("k.*")
    rows = boxed(docs, doc_id=F.col("doc_id"), sig=F.xxhash64("text"))
    found = rows.join(materialise(kept, "survivors"), ["doc_id", "sig"])
    order = F.when(F.col("n") > 1, F.to_json("row")).otherwise("")
    named = found.groupBy("doc_id", "sig").agg(F.min_by("row", order).alias("row"))
    return unboxed(named.select("row").union(rows.where("doc_id IS NULL").select("row")))
