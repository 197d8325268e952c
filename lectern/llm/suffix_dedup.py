"""Operator 3: exact-substring dedup with a column-wise multi-document suffix-array construction.

The construction (``build``) takes a collection of byte strings and inserts one symbol of each
string in every round, from the right, into the collection's Burrows-Wheeler transform; the
longest common prefixes of neighbouring suffixes are updated in the same pass. Both live in
external files, a task's own scratch that ends with it, which each round reads from front to
back in blocks of ``BLOCK`` rows, once to find the places of the new suffixes and once to
write the next files with them; between blocks 256 counts and least prefixes are held. There
are as many rounds as the longest string has symbols, so whole documents, of any length, are
not inserted as they are. They are cut first:

1. Copies of a text are set aside: all but that of the smallest doc_id are covered whole.
2. Every 50-byte string belongs to the smallest hash of its 24-byte strings. Runs of up to 27
   strings that share it make a piece of at most 76 bytes; equal 50-byte strings have equal
   hashes, so their pieces meet in one bucket. Only hashes are shuffled at first (``entries``).
3. Pieces whose hash occurs in one document alone can't repeat across documents and go.
4. The bytes of the others are shuffled by bucket, and each bucket's different pieces are
   built into collections of half a MB, in at most 77 rounds. Neighbours with common prefixes
   of 50 and more are equal 50-byte strings; those of a document with a larger doc_id than
   the group's smallest are covered.
5. The covered places return to their documents, where overlaps are merged and cut out.

Common hashes are split before each shuffle. What a task sees of a hash in two documents or
more is known to be shared, and only the smallest and the largest document go to the hash's
bucket to speak for the rest. Of equal pieces that a task holds only those of the smallest
document are built; the others are covered by it. So a bucket gets two entries, and one piece
of each content, from a task's part of the texts, however many documents share them. The
rest goes straight on to its documents (rows of kind 1). There is a bucket for every
``PER_BUCKET`` bytes of text.

Shuffled values are packed, many to a row. What is joined with
texts is written first. Texts are shuffled for both joins at any size, so that disk grows in
proportion; only the list of copies is broadcast, if its counted rows are few.

Defined results: a null text is empty. A null doc_id is smaller than none: such rows keep all
bytes and cover nothing. Rows that repeat a doc_id cover nothing in each other, whatever their
texts; rows that repeat a doc_id with one text are cut once. An empty table gives no rows.
Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, partitions, release, runs, salted_join, small
from lectern.llm.decontaminate import BASE, mixed, powers

#: Bytes of a string that counts as repeated, of the strings whose smallest hash it belongs to, and the windows of a piece.
LENGTH, GRAM = 50, 24
MOST = LENGTH - GRAM + 1
#: Least number of buckets, bytes of text for each of more, and fine buckets of each.
BUCKETS, PER_BUCKET, STEP = 256, 1 << 25, 16
#: Bytes of text, and pieces, that a task holds before it deals them out.
HELD, HELD_PIECES = 1 << 23, 150_000
#: Bytes of a collection that is built at once, and rows of its columns that are read at a time.
COLLECTION, BLOCK = 1 << 19, 1 << 19
END = 255  # stands after each string; no byte of UTF-8


# ---- packed columns -------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as differences, by byte planes, compressed."""
    n = len(columns[0])
    planes = [np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([n.to_bytes(8, "little"), *planes]))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.cumsum(np.ascontiguousarray(planes).view(kind).reshape(n), dtype=kind))
        at += n * width
    return out


def dealt(bucket: np.ndarray, *columns: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket and its part of the columns, in order; bucket has that of each of ``rows``, all if none are given."""
    if len(bucket):
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        values, first = np.unique(bucket[order], return_index=True)
        ends = [*first[1:].tolist(), len(bucket)]
        at = order if rows is None else rows[order]
        ordered = [c[at] for c in columns]
        for value, a, b in zip(values.tolist(), first.tolist(), ends, strict=True):
            yield value, [c[a:b] for c in ordered]


def document_bucket(doc: np.ndarray, buckets: Buckets) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % np.uint64(buckets.tasks)).astype(np.int64)


class Buckets(NamedTuple):
    """How many buckets values are dealt to, and how many tasks work through them."""

    count: int
    tasks: int


def buckets_for(docs: DataFrame) -> Buckets:
    wanted = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PER_BUCKET + 1
    return Buckets(max(BUCKETS, wanted), max(2 * partitions(docs.sparkSession), wanted))


def shuffled(df: DataFrame, buckets: Buckets, merge: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """merge(rows of one bucket) over rows (bucket, ...)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, "bucket", 1):
            for _, rows in frame.groupby("bucket", sort=True):
                yield from merge(rows)

    return df.repartition(buckets.tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


# ---- pieces ---------------------------------------------------------------------------


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, start, windows, hash) of the pieces of texts of LENGTH bytes and more."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts])
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
    least = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1] + np.uint64(BASE))
    width = 1
    while 2 * width <= MOST:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < MOST:
        least = np.minimum(least[: len(least) - (MOST - width)], least[MOST - width :])
    ends = np.cumsum(lengths)
    # Windows begin where LENGTH bytes of the same text follow.
    count = np.maximum(lengths - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    least = least[place + (ends - lengths)[owner]]
    fresh = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, np.int64)
    run = np.diff(np.r_[fresh, len(owner)])
    parts = -(-run // MOST)
    extra = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(fresh, parts) + extra * MOST
    windows = np.minimum(np.repeat(run, parts) - extra * MOST, MOST)
    return owner[at], place[at], windows, least[at]


def entries(docs: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, kind, blob): every piece's hash, document, start and windows, by hash (kind 0); those known to be shared go on by any bucket (1)."""
    count = np.uint64(buckets.count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush() -> pd.DataFrame:
            key, doc, sig, start, windows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
            size = np.diff(np.r_[first, len(key)])
            # Only hashes that stand here twice or more are looked at further.
            at = order[np.repeat(size > 1, size)]
            size = size[size > 1]
            begin = np.cumsum(size) - size
            own = doc[at]
            least, most = (np.repeat(f.reduceat(own, begin), size) if len(at) else own for f in (np.minimum, np.maximum))
            # One entry of the smallest document and one of the largest speak for a common hash.
            speak = np.zeros(len(at), dtype=bool)
            group = np.repeat(np.arange(len(size)), size)
            for end in (least, most):
                fits = np.flatnonzero(own == end)
                speak[fits[np.unique(group[fits], return_index=True)[1]]] = True
            rest = np.sort(at[(least < most) & ~speak])  # by document: they pack well
            del order, first
            stay = np.ones(len(key), dtype=bool)
            stay[rest] = False
            stay = np.flatnonzero(stay)
            bucket = ((key >> np.uint64(32)) * count >> np.uint64(32)).astype(np.int32)
            low = key & np.uint64((1 << 44) - 1)
            rows = [(b, 0, pack(*part)) for b, part in dealt(bucket[stay], low, doc, sig, start, windows, rows=stay)]
            for i in np.array_split(rest, -(-len(rest) // 50_000) or 1):
                if len(i):
                    fine = (bucket[i].astype(np.int64) * STEP + (low[i] >> np.uint64(40)).astype(np.int64)).astype(np.uint32)
                    rows.append((int(mixed(doc[i[:1]].view(np.uint64))[0] % count), 1, pack(doc[i], sig[i], start[i], windows[i], fine)))
            return pd.DataFrame(rows, columns=["bucket", "kind", "blob"])

        for batch in batches:
            for ids, sigs, texts in slices(batch, 1 << 19):
                new = [i for i, name in enumerate(zip(ids.tolist(), sigs.tolist(), strict=True)) if name not in seen and not seen.add(name)]
                owner, start, windows, key = cut([texts[i] for i in new])
                # Least hashes are small ones: mixed again, they spread over all buckets alike.
                held.append((mixed(key), ids[new][owner], sigs[new][owner], start.astype(np.uint32), windows.astype(np.uint8)))
                size += sum(len(texts[i]) for i in new)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if size:
            yield flush()

    return docs.mapInPandas(run, "bucket int, kind int, blob binary")


def slices(batch: pd.DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    ids, sigs = batch["doc_id"].to_numpy(dtype=np.int64), batch["sig"].to_numpy(dtype=np.int64)
    texts: list[bytes] = []
    begin = size = 0
    for i, text in enumerate(batch["text"]):
        texts.append(text.encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= most or i == len(batch) - 1:
            yield ids[begin : i + 1], sigs[begin : i + 1], texts
            texts, begin, size = [], i + 1, 0


ENTRY = ("u8", "i8", "i8", "u4", "u1")
PIECE = ("i8", "i8", "u4", "u1", "u4")
RANGE = ("i8", "i8", "u4", "u1")


def unpacked(blobs: pd.Series, *kinds: str) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(b, *kinds) for b in blobs), strict=True)] if len(blobs) else [np.zeros(0, k) for k in kinds]


def passed_on(rows: pd.DataFrame, kinds: tuple[str, ...], buckets: Buckets) -> Iterator[pd.DataFrame]:
    """The rows of kind 1, dealt by document."""
    for blob in rows["blob"][rows["kind"] == 1]:
        columns = unpack(blob, *kinds)
        yield pd.DataFrame([(b, pack(*part)) for b, part in dealt(document_bucket(columns[0], buckets), *columns)], columns=["bucket", "blob"])


def shared(found: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, blob): the pieces whose hash occurs in two documents or more, dealt by document."""

    def merge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from passed_on(rows, PIECE, buckets)
        key, doc, sig, start, windows = unpacked(rows["blob"][rows["kind"] == 0], *ENTRY)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
        keep = np.sort(order[np.repeat(several, np.diff(np.r_[first, len(key)]))])
        fine = (int(rows["bucket"].iloc[0]) * STEP + (key[keep] >> np.uint64(40)).astype(np.int64)).astype(np.uint32)
        told = (doc[keep], sig[keep], start[keep], windows[keep], fine)
        out = [(b, pack(*part)) for b, part in dealt(document_bucket(told[0], buckets), *told)]
        yield pd.DataFrame(out, columns=["bucket", "blob"])

    return shuffled(found, buckets, merge, "bucket int, blob binary")


def by_document(found: DataFrame, buckets: Buckets, kinds: tuple[str, ...], pack_rows: Callable[..., bytes]) -> DataFrame:
    """(s_doc, s_sig, blob): what packed rows hold for each document, each start once."""

    def merge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        columns = unpacked(rows["blob"], *kinds)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]
        columns = [c[fresh] for c in columns]
        doc, sig = columns[0], columns[1]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])])
        parts = zip(first, np.r_[first[1:], len(doc)], strict=True)
        yield pd.DataFrame({"s_doc": doc[first], "s_sig": sig[first], "blob": [pack_rows(*(c[a:b] for c in columns[2:])) for a, b in parts]})

    return shuffled(found, buckets, merge, "s_doc long, s_sig long, blob binary")


def pieces(docs: DataFrame, wanted: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, kind, blob, bytes): the bytes of the wanted pieces by hash (kind 0), and what a smaller document of the same task covers (1)."""
    joined = docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("s_doc")) & (F.col("sig") == F.col("s_sig"))).select("doc_id", "sig", "text", "blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()
        taken: list[bytes] = []

        def flush() -> pd.DataFrame:
            doc, sig, start, windows, fine = (np.concatenate(x) for x in zip(*held, strict=True))
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(t, len(known)) for t in taken])
            least = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            go, rest = np.flatnonzero(doc == least[which]), np.flatnonzero(doc > least[which])
            rows = []
            for b, (which_ones, *part) in dealt(fine[go].astype(np.int64) // STEP, np.arange(len(doc)), doc, sig, start, windows, fine, rows=go):
                data = zstandard.ZstdCompressor(level=1).compress(b"".join([taken[j] for j in which_ones.tolist()]))
                rows.append((b, 0, pack(*part), data))
            for i in np.array_split(rest, -(-len(rest) // 50_000) or 1):
                if len(i):
                    rows.append((int(mixed(doc[i[:1]].view(np.uint64))[0] % np.uint64(buckets.count)), 1, pack(doc[i], sig[i], start[i], (windows[i] + np.uint8(LENGTH - 1)).astype(np.uint8)), None))
            return pd.DataFrame(rows, columns=["bucket", "kind", "blob", "bytes"])

        for batch in batches:
            for doc, sig, text, blob in zip(batch["doc_id"], batch["sig"], batch["text"], batch["blob"], strict=True):
                if (doc, sig) in seen:
                    continue
                seen.add((doc, sig))
                start, windows, fine = unpack(blob, "u4", "u1", "u4")
                data = text.encode("utf-8", "surrogatepass")
                taken += [data[a : a + n + LENGTH - 1] for a, n in zip(start.tolist(), windows.tolist(), strict=True)]
                held.append((np.full(len(start), doc), np.full(len(start), sig), start, windows, fine))
                if len(taken) >= HELD_PIECES:
                    yield flush()
                    held, taken = [], []
                    seen.clear()
        if held:
            yield flush()

    return joined.mapInPandas(run, "bucket int, kind int, blob binary, bytes binary")


# ---- the construction -----------------------------------------------------------------


class Columns:
    """The transform and the common prefixes, in external files that are read and written from front to back, a block at a time, two of each in turn."""

    def __init__(self, folder: str) -> None:
        self.files = [[open(os.path.join(folder, f"{name}.{turn}"), "w+b", buffering=0) for name in ("bwt", "lcp")] for turn in (0, 1)]  # noqa: SIM115
        self.turn, self.rows, self.coming = 0, 0, 0

    def append(self, *columns: np.ndarray) -> None:
        """Write on to the files of the coming turn."""
        if not self.coming:
            for file in self.files[1 - self.turn]:
                file.seek(0)
        self.coming += len(columns[0])
        for file, column in zip(self.files[1 - self.turn], columns, strict=True):
            left = memoryview(column)
            while left:
                left = left[file.write(left) :]

    def change(self) -> None:
        """What was written is what is read from now on."""
        self.turn, self.rows, self.coming = 1 - self.turn, self.coming, 0

    def blocks(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, transform, common prefixes) of so many rows at a time."""
        for file in self.files[self.turn]:
            file.seek(0)
        for begin in range(0, self.rows, most):
            out = []
            for file in self.files[self.turn]:
                column, at = np.empty(min(most, self.rows - begin), dtype=np.uint8), 0
                while at < len(column):
                    at += file.readinto(memoryview(column)[at:])
                out.append(column)
            yield begin, out[0], out[1]

    def close(self) -> None:
        for file in (*self.files[0], *self.files[1]):
            file.close()


def ranked(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted by their symbol, and each row's place in that order."""
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank


def least_between(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of lcp[lo:hi] for ranges of one row at least."""
    back = np.argsort(-lo)  # so that nothing between two ranges is read
    least = np.empty(len(lo), dtype=np.uint8)
    least[back] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), np.stack([lo[back], hi[back]], axis=1).ravel())[::2]
    return least


def scanned_whole(files: Columns, place: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``scanned`` finds, of columns that are one block: then a row's place in the symbols' order is where it leads to."""
    _, bwt, lcp = next(files.blocks(block))
    order, rank = ranked(bwt)
    to = rank[place]
    new = np.sort(to)
    after = new[np.append(new[1:] != new[:-1] + 1, True)] + 1
    ask = np.concatenate([new, after])
    ask = ask[(ask > 0) & (ask < len(order))]
    a, b = order[ask - 1], order[ask]
    same = (bwt[a] == bwt[b]) & (bwt[a] != END)
    if not same.any():
        return to, ask[:0], np.zeros(0, np.uint8)
    return to, ask[same], least_between(lcp, a[same] + 1, b[same] + 1) + np.uint8(1)


def scanned(files: Columns, place: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over the columns: (the places that the rows at ``place``, sorted, lead to; the places of what is asked, and their common prefixes). counts: rows of each symbol.

    The k-th row of a symbol leads to the k-th suffix that begins with it. What is asked are the
    prefixes that a new suffix and the one after it share with those before them: one more than
    the least prefix since the symbol's last row. For symbols whose last row is in an earlier
    block, ``since`` holds the least so far; ``open_`` marks those whose next row is asked.
    """
    if files.rows <= block:
        return scanned_whole(files, place, block)
    seen, since, open_ = np.zeros(256, np.int64), np.full(256, 255, np.uint8), np.zeros(256, bool)
    symbols, occurrences, asked, prefixes = [], [], [], []
    at = 0
    for begin, bwt, lcp in files.blocks(block):
        stop = int(np.searchsorted(place, begin + len(bwt)))
        own = place[at:stop] - begin
        at = stop
        order, rank = ranked(bwt)
        first = np.zeros(257, dtype=np.int64)
        np.cumsum(np.bincount(bwt, minlength=256), out=first[1:])
        here = rank[own]
        sym = bwt[own]
        symbols.append(sym)
        occurrences.append(here - first[sym] + seen[sym])
        # The asked places of this block's order: the new rows, and those after them of the same symbol.
        new = np.sort(here)
        after = new[np.append(new[1:] != new[:-1] + 1, True)] + 1 if len(new) else new
        after = after[after < len(bwt)]
        after = after[bwt[order[after]] == bwt[order[after - 1]]]
        pending = np.flatnonzero(open_ & (first[1:] > first[:-1]))
        ask = np.unique(np.concatenate([new, after, first[pending]]))
        s = bwt[order[ask]]
        ask, s = ask[s != END], s[s != END]
        place_of = ask - first[s] + seen[s]  # the occurrence
        prefix = np.zeros(len(ask), dtype=np.uint8)
        close = ask > first[s]
        if close.any():
            prefix[close] = least_between(lcp, order[ask[close] - 1] + 1, order[ask[close]] + 1) + 1
        far = ~close & (seen[s] > 0)
        if far.any():
            running = np.minimum.accumulate(lcp)
            prefix[far] = np.minimum(since[s[far]], running[order[ask[far]]]) + 1
        open_[pending] = False
        open_[sym[here + 1 == first[sym.astype(np.int64) + 1]]] = True
        there = np.flatnonzero(first[1:] > first[:-1])
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        last = order[first[there + 1] - 1] + 1
        since = np.minimum(since, tail[0])
        since[there] = np.where(last < len(bwt), tail[np.minimum(last, len(bwt) - 1)], 255)
        seen += np.diff(first)
        asked.append(place_of + (s.astype(np.int64) << 40))
        prefixes.append(prefix)
    starts = np.cumsum(counts) - counts
    told = np.concatenate(asked)
    return starts[np.concatenate(symbols)] + np.concatenate(occurrences), starts[told >> 40] + (told & ((1 << 40) - 1)), np.concatenate(prefixes)


def build(strings: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a collection of up to 2^30 bytes: (transform, common prefix with the suffix before, string, suffix length), in suffix order."""
    m = len(strings)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    ends = np.cumsum(lengths)
    before = lambda s, j: np.where(lengths[s] > j, data[np.maximum(ends[s] - j - 1, 0)], END).astype(np.uint8)  # noqa: E731  the symbol before the last j
    place = np.arange(m)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        files = Columns(folder)
        symbols = before(place, 0)
        counts = np.bincount(symbols, minlength=256)
        files.append(symbols, np.zeros(m, np.uint8))
        files.change()
        order = np.arange(m)  # the strings that are not through, by their places
        for j in range(1, int(lengths.max()) + 1):
            order = order[lengths[order] >= j]
            rank, asked, prefix = scanned(files, place[order], counts, block)
            place[order] = m + rank
            # The new rows in their order, and the rows whose common prefix changes, go in as the old ones pass by.
            sort = np.argsort(rank)
            order, at = order[sort], m + rank[sort].astype(np.int64)
            symbols = before(order, j)
            counts += np.bincount(symbols, minlength=256)
            asked += m
            if files.rows > block:
                by = np.argsort(asked)
                asked, prefix = asked[by], prefix[by]
            taken = done = told = 0
            for _, bwt, lcp in files.blocks(block):
                # So many rows come out of this block: its own, and the new ones among them.
                stop = int(np.searchsorted(at - np.arange(len(at)), taken + len(bwt), "left")) if taken + len(bwt) < files.rows else len(at)
                new = at[done:stop] - (taken + done)
                total = len(bwt) + len(new)
                out_bwt, out_lcp, old = np.empty(total, np.uint8), np.zeros(total, np.uint8), np.ones(total, bool)
                old[new] = False
                out_bwt[old], out_lcp[old] = bwt, lcp
                out_bwt[new] = symbols[done:stop]
                end = int(np.searchsorted(asked, taken + done + total)) if files.rows > block else len(asked)
                out_lcp[asked[told:end] - (taken + done)] = prefix[told:end]
                files.append(out_bwt, out_lcp)
                taken, done, told = taken + len(bwt), stop, end
            files.change()
        parts = [(bwt, lcp) for _, bwt, lcp in files.blocks(block)]
        bwt, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
        files.close()
    # The rows' names: from the empty suffixes on, each row leads to that of the next longer suffix.
    string, size = np.empty(len(bwt), dtype=np.int64), np.zeros(len(bwt), dtype=np.int64)
    _, rank = ranked(bwt)
    place = np.arange(m)
    string[place] = place
    for j in range(1, int(lengths.max()) + 1):
        active = np.flatnonzero(lengths >= j)
        place[active] = m + rank[place[active]]
        string[place[active]], size[place[active]] = active, j
    return bwt, lcp, string, size


def least_documents(strings: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, least): for the windows of all strings in a row, the smallest doc of an equal window; first is each string's first."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    first = np.cumsum(lengths - LENGTH + 1) - (lengths - LENGTH + 1)
    _, lcp, string, size = build(strings)
    long = np.flatnonzero(size >= LENGTH)
    begins = np.flatnonzero(np.r_[True, lcp[1:] < LENGTH])
    group = np.cumsum(np.r_[True, lcp[1:] < LENGTH]) - 1
    least = np.minimum.reduceat(doc[string], begins)[group]
    out = np.empty(int((lengths - LENGTH + 1).sum()), dtype=np.int64)
    out[first[string[long]] + lengths[string[long]] - size[long]] = least[long]
    return first, out


def covered(found: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, blob): document, start and length of bytes that a smaller document has too, dealt by document."""

    def merge(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from passed_on(rows, RANGE, buckets)
        rows = rows[rows["kind"] == 0]
        if not len(rows):
            return
        doc, sig, start, windows, fine = unpacked(rows["blob"], *PIECE)
        data = b"".join(zstandard.ZstdDecompressor().decompress(b) for b in rows["bytes"])
        size = windows.astype(np.int64) + LENGTH - 1
        ends = np.cumsum(size)
        order = np.argsort(fine, kind="stable")
        # Whole fine buckets, about COLLECTION bytes at a time.
        filled = np.cumsum(size[order]) // COLLECTION
        last = np.flatnonzero(np.r_[fine[order][1:] != fine[order][:-1], True])
        stops = last[np.flatnonzero(np.r_[np.diff(filled[last]) > 0, True])] + 1
        for part in np.split(order, stops[:-1]):
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(data[ends[i] - size[i] : ends[i]], len(known)) for i in part.tolist()])
            least = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc[part])
            first, smallest = least_documents(list(known), least)
            owner = np.repeat(np.arange(len(part)), windows[part])
            at = np.arange(len(owner)) - np.repeat(np.cumsum(windows[part], dtype=np.int64) - windows[part], windows[part])
            hit = smallest[first[which[owner]] + at] < doc[part][owner]
            owner, at = owner[hit], at[hit]
            if not len(owner):
                continue
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]
            begin = np.flatnonzero(fresh)
            end = np.r_[begin[1:], len(owner)] - 1
            row = part[owner[begin]]
            a, n = (start[row] + at[begin]).astype(np.uint32), (at[end] - at[begin] + LENGTH).astype(np.uint8)
            told = (doc[row], sig[row], a, n)
            out = [(b, pack(*part)) for b, part in dealt(document_bucket(told[0], buckets), *told)]
            yield pd.DataFrame(out, columns=["bucket", "blob"])

    return shuffled(found, buckets, merge, "bucket int, blob binary")


def merged(start: np.ndarray, length: np.ndarray) -> bytes:
    """Sorted ranges as maximal runs."""
    end = np.maximum.accumulate(start.astype(np.int64) + length)
    fresh = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return pack(start[fresh].astype(np.uint32), (end[np.r_[fresh[1:] - 1, len(end) - 1]]).astype(np.uint32))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, text, blob, copy): the runs to remove; copy marks texts that a smaller document repeats whole."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    long = own.where(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}")
    ids = long.select("doc_id", "sig", F.xxhash64(F.lit("second"), "text").alias("sig2"), F.octet_length("text").alias("size"))
    whole = ["sig", "sig2", "size"]
    grouped = ids.groupBy(*whole).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    least = materialise(grouped.where("least < most").drop("most"), "copied")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = salted_join(ids, least, whole, "n", total).where("doc_id > least")
    copies = materialise(later.select(F.col("doc_id").alias("s_doc"), F.col("sig").alias("s_sig")).distinct(), "copies")
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("sig") == F.col("s_sig"))
    texts = long.join(small(copies, 32), same, "left_anti").select("doc_id", "sig", "text")
    buckets = buckets_for(long)
    wanted = materialise(by_document(shared(entries(texts, buckets), buckets), buckets, PIECE, pack), "shared-pieces")
    release(docs.sparkSession)  # the first half's shuffles
    found = by_document(covered(pieces(texts, wanted, buckets), buckets), buckets, RANGE, merged)
    removed = materialise(found.select("*", F.lit(False).alias("copy")).union(copies.select("s_doc", "s_sig", F.lit(None).cast("binary"), F.lit(True))), "removed-runs")
    del found, wanted
    release(docs.sparkSession)  # and those of the second
    return own.join(removed.hint("merge"), same, "left").select("doc_id", "sig", "text", "blob", "copy")


def apply(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that remain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 1000] for i in range(0, len(batch), 1000)):
                rows = []
                for text, blob, copy in zip(part["text"], part["blob"], part["copy"], strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    begin, end = [], []
                    if copy is True or copy == 1:
                        begin, end = [0], [len(data)]
                    elif blob is not None:
                        begin, end = (x.tolist() for x in unpack(blob, "u4", "u4"))
                    kept = b"".join(data[a:b] for a, b in zip([0, *end], [*begin, len(data)], strict=True))
                    rows.append((len(data), len(data) - len(kept), len(begin), kept))
                ids = part["doc_id"].astype("Int64")
                yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(doc_id=ids.to_numpy(dtype=object, na_value=None))[["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]]

    return spans(docs).select("doc_id", "text", "blob", "copy").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return apply(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
