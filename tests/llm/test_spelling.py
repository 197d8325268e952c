import random
import zlib
from collections import Counter

import pytest
import regex

from lectern.llm import spelling
from tests.llm.helpers import frame

LOWER = str.maketrans(spelling.CAPITALS, spelling.SMALL)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def found(docs):
    df = spelling.groups(docs)
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted(tuple(r) for r in df.collect())


def variants(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcéÿ") + word[i:], word[:i] + rng.choice("abcéÿ") + word[i + 1 :]])


def test_equals_brute_force(spark):
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdéÀ") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    rows = [(900, None), (901, ""), (None, "Wordwords wordwords"), (None, "wordwords"), (902, "x" * 5000 + " " + "x" * 5000), (903, "q1w2e3 ſtraſſenbahn Straßenbahn straßenbahn"), (904, "stepped " * 2 + "steppedx " * 25 + "steppedxy " * 260)]
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.5)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                w = variants(rng, w)
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice([" ", "-", "7"]).join(words)))
    rows += rows[-20:]
    docs = frame(spark, [t for _, t in rows], [d for d, _ in rows]).selectExpr("*", "1 AS word", "2 AS n", "3 AS `best.word`")
    got = found(docs)
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 30
    assert any(r[1] != r[2] for r in got if r[1])


def test_chains_reach_their_end(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]  # each ten times as frequent as the one before
    words = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    near_words = spelling.near_words(words)
    assert {(r["word"], r["form"], r["n_near"]) for r in near_words.collect()} == {(chain[0], chain[1], 1), (chain[1], chain[2], 2), (chain[2], chain[3], 2), (chain[3], None, 1)}
    assert {tuple(r) for r in spelling.roots(near_words).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_ties_go_to_the_first_word(spark):
    words = spark.createDataFrame([("bbbbbbb", 2), ("bbbbbbc", 20), ("bbbbbbé", 20), ("abbbbbb", 20), ("bbbbbbbb", 19)], "word string, n long")
    assert {r["word"]: (r["form"], r["n_near"]) for r in spelling.near_words(words).collect()}["bbbbbbb"] == ("abbbbbb", 4)


@pytest.mark.parametrize("texts", [[], [None, ""], ["short one", "12 34"]])
def test_nothing_to_find(spark, texts):
    assert found(frame(spark, texts or [None]).where("true" if texts else "false")) == []
