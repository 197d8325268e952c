import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lectern.llm import packing
from tests.llm.helpers import frame


def brute_ids(text):
    return Tokenizer.from_file(packing.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", " ", "It's a   test\n\n isn't it?", "Éa𝒳 <|endoftext|> x<|startoftext|>", "á ́b Σας ΟΔΟΣ", "tab\there\x0bvt\x1cfs nb ls", "word " * 5000, "９ ½ ﬁ 'S DON'T", "x" * 3000]


def test_pieces_equal_brute_force(spark):
    got = {(r["doc_id"], r["piece"]): r for r in packing.packed(frame(spark, TEXTS)).collect()}
    n = 0
    for d, text in enumerate(TEXTS):
        ids = brute_ids(text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            r = got[d, piece]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), text[:30]
            n += 1
    assert n == len(got)


def sound(rows, length=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    return len(by)


def test_sequences_are_gapless_and_few(spark):
    rng = random.Random(8)
    texts = [" ".join("ab" for _ in range(rng.randint(0, 1500))) for _ in range(400)]
    rows = packing.packed(frame(spark, texts + texts[:3], [*range(400), 0, 1, None])).collect()
    assert len(rows) == 403
    total = sum(r["length"] for r in rows)
    assert sound(rows) <= total / 2048 * 1.02 + 4


def test_two_replace_the_smallest():
    # Greedy gives 60 + 30 and leaves 10; 60 with 21 + 19 fills it.
    assert sorted(map(sorted, packing.pack(np.array([60, 30, 21, 19]), 100))) == [[19, 21, 60], [30]] or len(packing.pack(np.array([60, 30, 21, 19]), 100)) == 2
    assert packing.two_that_fit(np.bincount([21, 19, 19], minlength=101), 40) in [(21, 19), (19, 21)]
    assert packing.two_that_fit(np.bincount([20], minlength=101), 40) == (0, 0)
    assert packing.two_that_fit(np.bincount([20, 20], minlength=101), 40) == (20, 20)


def test_packs_every_piece_once():
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins = packing.pack(lengths, 100)
        assert sorted(s for b in bins for s in b) == sorted(lengths)
        assert max(map(sum, bins)) <= 100


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    encode = packing.Encoder(packing.default_vocabulary())
    rng = random.Random(10)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("aB'sté.!1 \u00b2\u0130ñ") for _ in range(80)) for _ in range(40)]
    for _ in range(2):
        for text, data in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == brute_ids(text)[:-1]


def test_empty_table(spark):
    assert packing.packed(frame(spark, ["a"]).where("false")).count() == 0
