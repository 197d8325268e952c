import random

import numpy as np
import xxhash

from lectern.llm import simhash
from lectern.llm.common import components
from tests.llm.helpers import WORD, frame


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints):
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    for text in ["", " \t", "One", "one TWO", "É À b c d", "a\x0bb\x0cc\rd", *(" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) for _ in range(50))]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_golay_code_is_perfect():
    words, excess, first = simhash.offsets(0)
    assert len(words) == 2048 and (np.diff(first) == 1).all()


def test_anchors_meet_every_pair_within_two_bits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for bits in [(), (0,), (5, 22), (22, 23), (30, 45), (45, 60), (62, 63), (10, 40)]:
        y = x.copy()
        for b in bits:
            y ^= np.uint64(1 << b)
        i, a, home = simhash.anchors(x)
        assert home.sum() == len(x)
        j, c, _ = simhash.anchors(y)
        reached = set(zip(j.tolist(), c.tolist(), strict=True))
        assert all(p in reached for p in zip(i[home].tolist(), a[home].tolist(), strict=True))


def test_crowded_anchor_links_what_pairs_link():
    rng = np.random.default_rng(5)
    words = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 14, (600, 4), dtype=np.uint64), axis=1))
    u, v = simhash.linked(words, 2)
    got = components(u, v, len(words))
    close = np.bitwise_count(words[:, None] ^ words) <= 2
    a, b = np.nonzero(close)
    assert (got == components(a, b, len(words))).all()
    assert (np.bitwise_count(words[u] ^ words[v]) <= 2).all()


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "a b", "A B", "solo"]
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(5):
            base[rng.randrange(300)] = "changed"
            texts.append(" ".join(base))
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in simhash.report(frame(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_roots(prints)


def test_survivors(spark):
    docs = frame(spark, ["a b c d", "a b c d", "x y z w v", "a b c d", None, ""], [5, 3, 9, 3, None, 8]).selectExpr("*", "1 AS fp", "2 AS component_id")
    out = simhash.survivors(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 8, 9]
    assert simhash.survivors(docs.where("false")).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["root"] for r in simhash.connected(chain).collect()} == {0}
