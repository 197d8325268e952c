"""Operator 12: substring dedup over words, by difference-cover anchors.

A word goes if a window of ``LENGTH`` words that covers it also starts in a document with a
smaller doc_id. Equal windows are found without hashing all of them:

1. ``COVER`` is a difference cover modulo ``PERIOD``: every distance is a difference of two of
   its members. Strings of ``GRAM`` words are hashed only at positions that are in the cover
   modulo the period, 3 of 7. Of two equal windows, at any two places, some string inside
   stands at such a position in both, at the same offset; so it is an anchor that they share.
2. Anchors are shuffled by hash. Those in one document alone go.
3. Each document's shared anchors are extended: the windows that hold one, up to ``PERIOD``
   for each, are hashed whole with 128 bits and shuffled by that. Of equal windows all
   but those of the smallest document are covered.
4. The covered windows return to their documents, where overlaps are merged and cut out.

Copies of a text are set aside first: all but that of the smallest doc_id are covered whole.
Common anchors and windows are split before the shuffles: what a task sees of an anchor in two
documents is known to be shared, and only the smallest and largest document speak for it in
its bucket; what a task sees of a window in a document that isn't its smallest is known
to be covered, and only the smallest goes on. No pairs are made. Buckets are as many
as ``PER_BUCKET`` bytes of text each ask for; a task holds one at a time.

Defined results: a null text is empty; texts of fewer than ``LENGTH`` words stay. A null
doc_id is smaller than none: such rows keep all words and cover nothing. Rows that repeat a
doc_id cover nothing in each other, whatever their texts. An empty table gives no rows. Only
``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, remove, salted_join, small, written_path
from lectern.llm.decontaminate import mixed, powers
from lectern.llm.suffix_dedup import Buckets, buckets_for, by_document, dealt, document_bucket, merged, pack, shuffled, slices, unpack, unpacked

LENGTH = 13
#: A difference cover of the smallest size; GRAM + PERIOD - 1 is LENGTH.
PERIOD, COVER = 7, (0, 1, 3)
GRAM = LENGTH - PERIOD + 1
#: Bytes of text that a task reads before it deals out what it has found, and windows that it holds.
HELD, HELD_WINDOWS = 1 << 23, 400_000
#: A hash (upper and lower half), the document, its text's hash and the position; and the last three.
ENTRY = ("u8", "u8", "i8", "i8", "u4")
PLACE = ("i8", "i8", "u4")


def words(text: str | None) -> list[bytes]:
    """The runs without the white space that the contract names, which is that of bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def anchors(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the strings of GRAM words at the cover's positions."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b" ".join(b" ".join(t) for t in texts if t), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    gap = np.flatnonzero(data == 32)
    begin, end = np.r_[0, gap + 1], np.r_[gap, len(data)]
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place <= counts[owner] - GRAM)) if len(owner) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
    a, b = begin[at], end[at + GRAM - 1]
    return owner[at], place[at], mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def around(positions: np.ndarray, n: int) -> np.ndarray:
    """The first words of the windows, in a text of n words, that hold an anchor at one of the positions."""
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, np.maximum(positions - PERIOD + 1, 0), 1)
    np.add.at(edge, positions + 1, -1)
    return np.flatnonzero(np.cumsum(edge[: max(0, n - LENGTH + 1)]))


def window_hashes(text: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit hashes of the windows at these words."""
    data = memoryview(b" ".join(text))
    end = np.cumsum([len(w) + 1 for w in text]) - 1
    first, last = np.r_[0, end[:-1] + 1][starts].tolist(), end[starts + LENGTH - 1].tolist()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first, last, strict=True)]), dtype=">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


# ---- hashes that documents share --------------------------------------------------------


def grouped(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, least, most): the order of the hashes, and in it their number and the smallest and largest document that has each."""
    order = np.lexsort((doc, low, high)) if low.any() else np.lexsort((doc, high))
    h, lo, own = high[order], low[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])]
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(order)] - 1
    return order, group, own[first][group], own[last][group]


def packed(found: list[tuple[np.ndarray, ...]], buckets: Buckets, known: Callable[..., tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Rows (bucket, kind, blob) of hashes (kind 0) and of places that are known to count already (1)."""
    high, low, doc, sig, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order, group, least, most = grouped(high, low, doc)
    asks, counts = known(group, doc[order], least, most)
    stay, rest = np.sort(order[asks]), np.sort(order[counts])
    bucket = ((high >> np.uint64(32)) * np.uint64(buckets.count) >> np.uint64(32)).astype(np.int32)
    rows = [(b, 0, pack(*part)) for b, part in dealt(bucket[stay], high, low, doc, sig, at, rows=stay)]
    for i in np.array_split(rest, -(-len(rest) // 50_000) or 1):
        if len(i):
            rows.append((int(mixed(doc[i[:1]].view(np.uint64))[0] % np.uint64(buckets.count)), 1, pack(doc[i], sig[i], at[i])))
    return pd.DataFrame(rows, columns=["bucket", "kind", "blob"])


def speakers(group: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors: one place of the smallest and one of the largest document ask for the others; where these differ, the rest is known to be shared."""
    edge = np.r_[True, group[1:] != group[:-1]] | np.r_[group[1:] != group[:-1], True]
    several = least < most
    return edge | ~several, ~edge & several


def smallest(group: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows: the smallest document asks for the others, all of which are known to be covered."""
    return doc == least, doc > least


def settled(entries: DataFrame, buckets: Buckets, counts: Callable[..., np.ndarray]) -> DataFrame:
    """(bucket, blob): the places that count, dealt by document."""

    def merge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        told = [unpack(b, *PLACE) for b in rows["blob"][rows["kind"] == 1]]
        asked = unpacked(rows["blob"][rows["kind"] == 0], *ENTRY)
        if len(asked[0]):
            order, _, least, most = grouped(*asked[:3])
            keep = np.sort(order[counts(asked[2][order], least, most)])
            told.append([c[keep] for c in asked[2:]])
        for columns in told:
            yield pd.DataFrame([(b, pack(*part)) for b, part in dealt(document_bucket(columns[0], buckets), *columns)], columns=["bucket", "blob"])

    return shuffled(entries, buckets, merge, "bucket int, blob binary")


def shared_anchors(docs: DataFrame, buckets: Buckets) -> DataFrame:
    """(s_doc, s_sig, blob): the positions of each document's anchors that another document has too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for ids, sigs, texts in slices(batch, 1 << 19):
                owner, place, key = anchors([t.split() for t in texts])
                held.append((key, np.zeros_like(key), ids[owner], sigs[owner], place.astype(np.uint32)))
                size += sum(map(len, texts))
                if size >= HELD:
                    yield packed(held, buckets, speakers)
                    held, size = [], 0
        if size:
            yield packed(held, buckets, speakers)

    entries = docs.mapInPandas(run, "bucket int, kind int, blob binary")
    return by_document(settled(entries, buckets, lambda doc, least, most: least < most), buckets, PLACE, pack)


def covered_windows(docs: DataFrame, wanted: DataFrame, buckets: Buckets) -> DataFrame:
    """(s_doc, s_sig, blob): the runs of words that windows of smaller documents cover."""
    joined = docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("s_doc")) & (F.col("sig") == F.col("s_sig"))).select("doc_id", "sig", "text", "blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for doc, sig, text, blob in zip(batch["doc_id"], batch["sig"], batch["text"], batch["blob"], strict=True):
                (positions,) = unpack(blob, "u4")
                own = words(text)
                starts = around(positions.astype(np.int64), len(own))
                for i in range(0, len(starts), HELD_WINDOWS):
                    part = starts[i : i + HELD_WINDOWS]
                    held.append((*window_hashes(own, part), np.full(len(part), doc), np.full(len(part), sig), part.astype(np.uint32)))
                    n += len(part)
                    if n >= HELD_WINDOWS:
                        yield packed(held, buckets, smallest)
                        held, n = [], 0
        if n:
            yield packed(held, buckets, smallest)

    entries = joined.mapInPandas(run, "bucket int, kind int, blob binary")
    return by_document(settled(entries, buckets, lambda doc, least, most: doc > least), buckets, PLACE, lambda at: merged(at, np.full(len(at), LENGTH)))


# ---- documents --------------------------------------------------------------------------


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, text, blob, copy): the runs of words to remove; copy marks texts that a smaller document repeats whole."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    long = own.where(f"doc_id IS NOT NULL AND octet_length(text) >= {2 * LENGTH - 1}")
    ids = long.select("doc_id", "sig", F.xxhash64(F.lit("second"), "text").alias("sig2"), F.octet_length("text").alias("size"))
    whole = ["sig", "sig2", "size"]
    copied = ids.groupBy(*whole).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    least = materialise(copied.where("least < most").drop("most"), "copied")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = salted_join(ids, least, whole, "n", total).where("doc_id > least")
    copies = materialise(later.select(F.col("doc_id").alias("s_doc"), F.col("sig").alias("s_sig")).distinct(), "copies")
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("sig") == F.col("s_sig"))
    texts = long.join(small(copies, 32), same, "left_anti").select("doc_id", "sig", "text")
    buckets = buckets_for(long)
    wanted = materialise(shared_anchors(texts, buckets), "shared-anchors")
    found = covered_windows(texts, wanted, buckets).select("*", F.lit(False).alias("copy"))
    removed = materialise(found.union(copies.select("s_doc", "s_sig", F.lit(None).cast("binary"), F.lit(True))), "removed-words")
    remove(docs.sparkSession, [written_path(t) for t in (least, copies, wanted)])
    return own.join(removed.hint("merge"), same, "left").select("doc_id", "sig", "text", "blob", "copy")


def cut(own: list[bytes], blob: bytes | None, copy: bool | None) -> tuple[list[int], list[int]]:
    """The first words of the runs that go, and the words behind them."""
    if copy is True or copy == 1:
        # A copy of fewer words than a window has no window to be covered by.
        return ([0], [len(own)]) if len(own) >= LENGTH else ([], [])
    return ([], []) if blob is None else tuple(x.tolist() for x in unpack(blob, "u4", "u4"))


def apply(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, begin, end, kept): the runs of words that go, ends exclusive, and the text of the words that stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 1000] for i in range(0, len(batch), 1000)):
                rows = []
                for text, blob, copy in zip(part["text"], part["blob"], part["copy"], strict=True):
                    own = words(text)
                    begin, end = cut(own, blob, copy)
                    kept = [w for a, b in zip([0, *end], [*begin, len(own)], strict=True) for w in own[a:b]]
                    rows.append((len(own), len(own) - len(kept), begin, end, b" ".join(kept).decode("utf-8", "surrogatepass")))
                ids = part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
                yield pd.DataFrame(rows, columns=["n_words", "n_removed", "begin", "end", "kept"]).assign(doc_id=ids)[["doc_id", "n_words", "n_removed", "begin", "end", "kept"]]

    return spans(docs).select("doc_id", "text", "blob", "copy").mapInPandas(run, "doc_id long, n_words long, n_removed long, begin array<int>, end array<int>, kept string")


def report(docs: DataFrame) -> DataFrame:
    return apply(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

