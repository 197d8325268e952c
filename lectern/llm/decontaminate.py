"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two in their number of distinct five-word shingles. The
MinHash signature of an item holds its smallest hash values: floor((1 - t) * n) + 1 of n, so
that a document which contains the share t of the item's shingles holds at least one of them.
Every partition has a bound, the largest value in its signatures. A document's sketch for a
partition are its hash values up to that bound, and it has one only for partitions whose items
it is large enough to contain. Sketches and signatures are joined partition by partition, in
both paths below; as sketches of one document are nested, the shuffled path sends each value
once, with the last partition it is for. The sketch has no fixed number of values, as that
would miss short items in long documents; so nothing is missed.
Candidates are verified by the exact containment of the item's shingles, as words.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. An item of
fewer than five words has one shingle, its words; for the lengths of such items, documents are
also cut into shingles of so many words. The signatures are sent to every task
if they are small, as counted; else sketches and signatures meet in a shuffled join, in which
every signature has ``SALTS`` copies and a document uses one of them, so that common values spread.

Defined results: null and empty texts and items have no shingles and match nothing. Repeated
items and documents give repeated rows of pairs only as often as their ids differ: a pair of
ids comes once, with its largest containment; null ids match nothing. ``clean`` goes by the
texts, whatever their doc_id, null too; other columns may have any names. Empty tables give
no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_BYTES, boxed, map_texts, materialise, small, unboxed

WORDS = 5
SALTS = 16
CONTAINED = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: True for the bytes of words, after lower case.
LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def table_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, dtype=np.uint64)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse, modulo 2^64, from 0 to n."""
    up, down = table_of_powers(1 << max(16, n.bit_length()))
    return up[: n + 1], down[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of its text), over all texts at once; a text of fewer words has the shingle of all its words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, LETTER[data], False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
    word = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    lengths = np.array([len(r) + 1 for r in raw])
    owner = np.searchsorted(np.cumsum(lengths), begin, side="right")
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    size = np.minimum(n, k)[owner]
    place = np.arange(len(word)) - first[owner]
    starts = np.flatnonzero(place <= n[owner] - size)
    h = size[starts].astype(np.uint64)
    for j in range(k):
        inside = j < size[starts]
        at = np.minimum(starts + j, len(word) - 1)
        h = np.where(inside, mixed(h * np.uint64(BASE) + word[at]), h)
    return h, owner[starts]


def shingle_words(text: str, k: int = WORDS) -> set[bytes]:
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def document_hashes(texts: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of shingles of all these sizes, ordered by text."""
    made = [shingle_hashes(texts, k) for k in sizes]
    h, owner = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.argsort(owner, kind="stable") if len(sizes) > 1 else slice(None)
    return h[order], owner[order]


def signatures(items: DataFrame, t: float = CONTAINED) -> DataFrame:
    """(item_id, text, n, words, h): the signature values of every item that has shingles, and of how many words these are."""

    def make(texts: list[str]) -> dict:
        h, owner = shingle_hashes(texts)
        sets = [np.unique(h[owner == i]) for i in range(len(texts))]
        least = [s[: int(np.floor((1 - t) * len(s) + 1e-9)) + 1] if len(s) else s for s in sets]
        words = [min(WORDS, len(WORD.findall(x.encode("utf-8", "surrogatepass").lower()))) for x in texts]
        return {"n": [len(s) for s in sets], "words": words, "h": [x.view(np.int64) for x in least]}

    own = items.where("item_id IS NOT NULL").withColumn("_text", F.col("text"))
    made = map_texts(own.select("item_id", "text", "_text"), "text", make, "n int, words int, h array<bigint>", ["item_id", "_text"], 200_000)
    part = F.floor(F.log2("n")).cast("int")
    return made.where("n > 0").select("item_id", F.col("_text").alias("item"), "n", part.alias("part"), "words", "h")


def bounds_of(known: DataFrame) -> list[tuple[int, int]]:
    """(partition, bound): the largest unsigned value in the signatures of each partition; there are 31 partitions at most."""
    flip = -(1 << 63)  # turns the order of unsigned numbers into that of signed ones
    each = known.select("part", F.explode("h").alias("h")).groupBy("part").agg(F.max(F.col("h").bitwiseXOR(F.lit(flip))).alias("m"))
    return sorted((r["part"], (r["m"] ^ flip) & ((1 << 64) - 1)) for r in each.collect())


def sketch(h: np.ndarray, counts: np.ndarray, bounds: list[tuple[int, int]], t: float) -> np.ndarray:
    """For values h of documents with so many shingles: the last partition each is in a sketch for, -1 if none."""
    last = np.full(len(h), -1, dtype=np.int32)
    for part, bound in bounds:
        last[(h <= np.uint64(bound)) & (counts >= np.floor(t * 2.0**part))] = part
    return last


def contained(document: str, items: list[tuple[int, str]], t: float, cached: dict) -> list[tuple[int, float]]:
    own: dict[int, set[bytes]] = {}
    out = []
    for item_id, item in items:
        if item not in cached:
            cached[item] = shingle_words(item)
        k = next(iter(cached[item])).count(b" ") + 1
        if k not in own:
            own[k] = shingle_words(document, k)
        share = len(cached[item] & own[k]) / len(cached[item])
        if share >= t - 1e-9:
            out.append((item_id, share))
    return out


def matches(docs: DataFrame, items: DataFrame, t: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, containment) of every pair at t or more."""
    known = materialise(signatures(items, t), "signatures")
    held = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    key = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {key}, containment double"
    sizes = [WORDS, *sorted(r["words"] for r in known.where(F.col("words") < WORDS).select("words").distinct().collect())]
    size = known.agg(F.coalesce(F.sum(F.length("item") + 8 * F.size("h") + 32), F.lit(0))).first()[0]
    bounds = bounds_of(known)
    if size <= BROADCAST_BYTES:
        rows = [(r["item_id"], r["item"], r["part"], np.array(r["h"], dtype=np.int64).view(np.uint64)) for r in known.collect()]
        names = [(r[0], r[1]) for r in rows]
        tables = []  # each partition's signature values in order, and the items they belong to
        for part, _ in bounds:
            mine = [(i, r[3]) for i, r in enumerate(rows) if r[2] == part]
            value = np.concatenate([v for _, v in mine])
            order = np.argsort(value, kind="stable")
            tables.append((part, value[order], np.repeat([i for i, _ in mine], [len(v) for _, v in mine])[order]))
        # A quick test on the upper bits spares most lookups.
        bits = np.zeros(1 << 20, dtype=bool)
        for _, value, _ in tables:
            bits[(value >> np.uint64(44)).astype(np.int64)] = True

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cached: dict = {}
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), list(batch["text"])
                begin = chars = 0
                for i, text in enumerate(texts):
                    chars += len(text)
                    if chars < 1_000_000 and i < len(texts) - 1:
                        continue
                    part = texts[begin : i + 1]
                    h, doc = document_hashes(part, sizes)
                    counts = np.bincount(doc, minlength=len(part))
                    near = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
                    last = sketch(h[near], counts[doc[near]], bounds, t)
                    pairs = []
                    for p, value, owner in tables:
                        mine = near[last >= p]
                        lo, hi = np.searchsorted(value, h[mine], "left"), np.searchsorted(value, h[mine], "right")
                        hit = np.repeat(mine, hi - lo)
                        at = np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                        large = counts[doc[hit]] >= np.floor(t * 2.0**p)
                        pairs.append(np.stack([doc[hit][large], owner[at][large]]))
                    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                    found = []
                    for d in np.unique(pairs[0]):
                        mine = [names[j] for j in pairs[1][pairs[0] == d]]
                        found += [(ids[begin + d], item, share) for item, share in contained(part[d], mine, t, cached)]
                    if found:
                        yield pd.DataFrame(found, columns=["doc_id", "item_id", "containment"])
                    begin, chars = i + 1, 0

        pairs = held.mapInPandas(run, schema)
    else:
        hashed = map_texts(held, "text", lambda texts: sketches(texts, sizes, bounds, t), "size int, h array<bigint>, last array<int>", ["doc_id"], 1_000_000)
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        each = hashed.select("doc_id", "size", salt.alias("salt"), F.explode(F.arrays_zip("h", "last")).alias("s")).select("doc_id", "size", "salt", "s.h", "s.last")
        wanted = known.select("item_id", "part", F.explode("h").alias("h")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = each.join(wanted, ["h", "salt"]).where((F.col("part") <= F.col("last")) & (F.col("size") >= F.floor(t * F.pow(2.0, "part")))).select("doc_id", "item_id").distinct()
        texts = found.join(held, "doc_id").join(known.select("item_id", "item"), "item_id")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(d, i, share) for d, text, i, item in zip(batch["doc_id"], batch["text"], batch["item_id"], batch["item"], strict=True) for i, share in contained(text, [(i, item)], t, {})]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "containment"])

        pairs = texts.mapInPandas(verify, schema)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def sketches(texts: list[str], sizes: list[int], bounds: list[tuple[int, int]], t: float) -> dict:
    h, owner = document_hashes(texts, sizes)
    counts = np.bincount(owner, minlength=len(texts))
    last = sketch(h, counts[owner], bounds, t)
    kept = np.flatnonzero(last >= 0)
    parts = [x[np.unique(h[x], return_index=True)[1]] for x in np.split(kept, np.searchsorted(owner[kept], np.arange(1, len(texts))))]
    return {"size": counts, "h": [h[x].view(np.int64) for x in parts], "last": [last[x] for x in parts]}


def clean(docs: DataFrame, items: DataFrame, t: float = CONTAINED) -> DataFrame:
    """docs without the documents that contain an item."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = materialise(matches(by_text, items, t).select(F.col("doc_id").alias("sig")).distinct(), "contaminated")
    return unboxed(boxed(docs, sig=F.when(F.col("text").isNotNull(), F.xxhash64("text"))).join(small(bad, 16), "sig", "left_anti"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS s FROM d, unnest(range(0, greatest(1, len(w) - 4))) AS t(p) WHERE len(w) > 0),
i_s AS (SELECT DISTINCT item_id, array_to_string(w[p + 1:p + 5], ' ') AS s FROM i, unnest(range(0, greatest(1, len(w) - 4))) AS t(p) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i_s GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n)::DOUBLE AS containment
FROM ds JOIN i_s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n)::DOUBLE >= 0.8 - 1e-9
"""
