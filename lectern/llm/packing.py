"""Operator 7: best-two-fit packing of tokenised documents into fixed-length sequences.

A bin is filled greedily: the largest unpacked piece that fits, again and again. If a gap is
left, the bin's smallest piece is taken out and the two unpacked pieces are looked for that
fill the expanded gap most tightly; they replace it if they fill more than it did. Bins are
packed over counts of pieces by length, so a step costs no more for many pieces than for few.

Documents are tokenised once, by words of whitespace-separated text with bounded caches of
their ids (the tokenizer drops white space and no token spans it). Only (document, piece,
start, length, checksum) is written, counted and dealt by a hash of document and piece to as
many tasks as there are ``BLOCK`` pieces; every block of so many pieces is packed by itself:
memory is bounded, and a block wastes a bin or so.

Defined results: a null or empty text is the end token alone, one piece of length 1. Longer
documents than a sequence are cut into whole sequences and a rest. Repeated rows are packed
as often as they come, a null doc_id like any other. An empty table gives no rows. Further
columns are not looked at.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise

LENGTH = 2048
END = 0
BLOCK = 200_000
#: Bytes that each of the two caches of a task may take, as counted with ENTRY bytes beside an entry's own, and the longest word that is kept.
CACHED, ENTRY, LONGEST = 64 << 20, 200, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters are cut as the tokenizer cuts them; the parts recur more often than the words.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own if it prints, else the next from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printed else next(rest)) for b in range(256)}


LETTERS = str.maketrans({chr(b): c for b, c in byte_letters().items()})


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. Both caches keep what comes first, the frequent words among it, up to CACHED bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.room = {id(self.words): CACHED, id(self.parts): CACHED}

    def keep(self, cache: dict[str, bytes], found: dict[str, bytes]) -> None:
        if self.room[id(cache)] > 0:
            short = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
            cache.update(short)
            self.room[id(cache)] -= sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)

    def many(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, from one call for thousands, told apart by where their tokens begin."""
        out = {}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            starts = np.array([a for a, _ in found.offsets], dtype=np.int64)
            ends = (4 * np.searchsorted(starts, np.cumsum([len(w) + 1 for w in part]))).tolist()
            out.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "replace").decode().replace("\n", " ").split(" ") for t in texts]
        found = {w: self.words.get(w) for w in set().union(*split)}
        new = [w for w, ids in found.items() if ids is None]
        plain = [w for w in new if PLAIN.fullmatch(w) and "<|" not in w]
        cut = [PART.findall(w.lower()) for w in plain]
        parts = {p: self.parts.get(p) for c in cut for p in c}
        tokenize = self.tokenizer.model.tokenize  # parts are in lower case and whole: only the merges are left to do
        unknown = [p for p, ids in parts.items() if ids is None]
        for p in unknown:
            parts[p] = array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(LETTERS))]).tobytes()
        known = parts.__getitem__
        made = dict(zip(plain, (b"".join(map(known, c)) for c in cut), strict=True))
        made.update(self.many([w for w in new if w not in made]))
        found.update(made)
        self.keep(self.parts, {p: parts[p] for p in unknown})
        self.keep(self.words, made)
        get = found.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker; its caches are bounded in bytes."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # hundreds of thousands of small lists and no cycle among them
        try:
            yield from cut(batches)
        finally:
            gc.enable()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), ["" if t is None else t for t in batch["text"]]
            begin = chars = 0
            for i, text in enumerate(texts):
                chars += len(text)
                if chars < 1_000_000 and i < len(texts) - 1:
                    continue
                rows = []
                for doc_id, data in zip(ids[begin : i + 1], encode(texts[begin : i + 1]), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * length)):
                        part = data[at : at + 4 * length]
                        rows.append((None if doc_id != doc_id else doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                begin, chars = i + 1, 0
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def two_that_fit(counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum that is not over gap; (0, 0) if there are none."""
    sizes = np.flatnonzero(counts[: gap + 1])
    if not len(sizes):
        return 0, 0
    at = np.searchsorted(sizes, gap - sizes, side="right") - 1
    other = sizes[np.maximum(at, 0)]
    fine = (at >= 0) & ((other != sizes) | (counts[sizes] > 1))
    lone = (at > 0) & (other == sizes) & (counts[sizes] == 1)
    other = np.where(lone, sizes[np.maximum(at - 1, 0)], other)
    total = np.where(fine | lone, sizes + other, 0)
    best = int(np.argmax(total))
    return (int(sizes[best]), int(other[best])) if total[best] else (0, 0)


def pack(lengths: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Bins as lists of lengths, for pieces of 1 to length tokens."""
    counts = np.bincount(lengths, minlength=length + 1)
    bins = [[length] for _ in range(int(counts[length]))]
    counts[length] = 0
    mask = sum(1 << int(s) for s in np.flatnonzero(counts))  # the lengths there are, for the largest under a limit

    def take(size: int) -> None:
        nonlocal mask
        counts[size] -= 1
        if not counts[size]:
            mask ^= 1 << size

    while mask:
        bin_: list[int] = []
        gap = length
        while fits := mask & ((2 << gap) - 1):
            size = fits.bit_length() - 1
            take(size)
            bin_.append(size)
            gap -= size
        if gap and mask:
            smallest = bin_[-1]
            a, b = two_that_fit(counts, gap + smallest)
            if a + b > smallest:
                take(a)
                take(b)
                bin_[-1:] = [a, b]
                if not counts[smallest]:
                    mask |= 1 << smallest
                counts[smallest] += 1
        bins.append(bin_)
    return bins


def place(frame: pd.DataFrame, first: int, length: int) -> pd.DataFrame:
    """frame with sequence_id from first on, and offset."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy()
    bins = pack(lengths, length)
    size = np.array([s for b in bins for s in b])
    sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    ends = np.cumsum(size)
    starts = ends - size
    offset = starts - starts[np.searchsorted(sequence, sequence)]
    order = np.argsort(size, kind="stable")  # the slots by length, as the pieces are
    return frame.assign(sequence_id=first + sequence[order], offset=offset[order])


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, held, block = TaskContext.get().partitionId() << 40, [], 0
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= BLOCK:
                yield place(pd.concat(held), base + (block << 24), length)
                held, count, block = [], 0, block + 1
        if count:
            yield place(pd.concat(held), base + (block << 24), length)

    cut = materialise(pieces(docs, vocabulary or default_vocabulary(), length), "pieces")
    tasks = max(1, -(-cut.count() // BLOCK))
    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
