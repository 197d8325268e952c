import hashlib
import random

import numpy as np
import pytest

from lectern.llm import suffix_dedup
from tests.llm.helpers import frame

K = suffix_dedup.LENGTH


def brute(rows):
    least = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - K + 1):
            if d is not None:
                s = data[i : i + K]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - K + 1):
            if d is not None and least[data[i : i + K]] < d:
                gone[i : i + K] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((d, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 2, 7, 50, 1 << 19])
def test_build_sorts_suffixes_with_common_prefixes(block):
    rng = random.Random(10)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        bwt, lcp, string, size = suffix_dedup.build(strings, block)
        suffixes = [strings[s][len(strings[s]) - n :] for s, n in zip(string, size, strict=True)]
        assert sorted(zip(string.tolist(), size.tolist(), strict=True)) == [(s, n) for s in range(len(strings)) for n in range(len(strings[s]) + 1)]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], lcp[1:], strict=False):
            common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n == common
        assert [int(c) for c in bwt] == [strings[s][len(strings[s]) - n - 1] if n < len(strings[s]) else suffix_dedup.END for s, n in zip(string, size, strict=True)]


def test_packing_round_trip():
    columns = [np.array([5, 1, 1 << 60], dtype=np.uint64), np.array([-3, 7, 7]), np.array([9, 0, 255], dtype=np.uint8)]
    back = suffix_dedup.unpack(suffix_dedup.pack(*columns), "u8", "i8", "u1")
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back, strict=True))


def test_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé𝒳") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    rows = [(900, None), (901, ""), (None, shared[0]), (902, "x" * 500), (3, "x" * 120), (903, "ab" * 300), (904, "ab" * 40), (905, shared[0]), (905, shared[0]), (905, shared[1]), (1, shared[0][:K]), (2, "y" * (K - 1)), (906, "y" * (K - 1))]
    for d in range(100, 140):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(shared)[rng.randint(0, 20) :], " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((d, " ".join(parts)))
    rows += [(d + 200, t) for d, t in rows[-10:]]
    docs = frame(spark, [t for _, t in rows], [d for d, _ in rows]).selectExpr("*", "1 AS sig", "2 AS blob", "3 AS copy")
    got = sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20


def test_empty_table(spark):
    assert suffix_dedup.report(frame(spark, ["a"]).where("false")).count() == 0


def test_collections_are_cut_at_buckets(spark, monkeypatch):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = [(i, base[rng.randint(0, 2000) : rng.randint(2000, 4000)]) for i in range(12)]
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 500)
    got = sorted((tuple(r) for r in suffix_dedup.report(frame(spark, [t for _, t in rows])).collect()), key=repr)
    assert got == brute(rows)


def test_common_hashes_are_split_before_the_shuffles(spark, monkeypatch):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, f"{word()} {shared[rng.randint(0, 5):]} {word()}") for i in rng.sample(range(1000), 60)]
    rows += [rows[0], rows[1], (rows[2][0], shared)]
    for name, value in (("HELD", 2000), ("HELD_PIECES", 40), ("BUCKETS", 8)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = sorted((tuple(r) for r in suffix_dedup.report(frame(spark, [t for _, t in rows], [d for d, _ in rows]).coalesce(2)).collect()), key=repr)
    assert got == brute(rows)


def test_very_many_rows_repeat_a_doc_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(25))
    docs = spark.range(100_000).selectExpr("7L AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(9, "x " + text + " y")], "doc_id long, text string"))
    found = suffix_dedup.report(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r[0], r[1] > 0, r[2]) for r in found} == {(7, False, 100_000), (9, True, 1)}
