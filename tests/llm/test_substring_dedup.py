import hashlib
import random

import numpy as np
import pytest

from lectern.llm import substring_dedup as sd
from tests.llm.helpers import WORD, frame

L = sd.LENGTH


def brute(rows):
    least, out = {}, []
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - L + 1):
            if d is not None:
                key = tuple(w[i : i + L])
                least[key] = min(least.get(key, d), d)
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - L + 1):
            if d is not None and least[tuple(w[i : i + L])] < d:
                gone[i : i + L] = [True] * L
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in sd.report(docs).collect()), key=repr)


def test_the_cover_has_every_distance():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    assert sd.GRAM + sd.PERIOD - 1 == L


def made(rng):
    word = lambda: rng.choice(["a", "b", "c", "é", "𝒳x", "dd", "E"])
    fresh = lambda n: [f"{word()}{rng.randrange(30)}" for _ in range(n)]
    shared = [fresh(rng.randint(10, 60)) for _ in range(8)]
    space = lambda w: "".join(x + rng.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for x in w)
    rows = [(900, None), (901, ""), (None, space(shared[0])), (902, "x " * 300), (3, "x " * 60), (905, space(shared[0])), (905, space(shared[0])), (905, space(shared[1])), (1, space(shared[0][:L])), (2, "y " * (L - 1)), (906, "y " * (L - 1)), (907, "a b " * 20), (908, "a b " * 20)]
    for d in range(100, 140):
        parts = fresh(rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared)[rng.randint(0, 9) :] + fresh(rng.randint(0, 9))
        rows.append((d, space(parts)))
    return rows + [(d + 200, t) for d, t in rows[-10:]]


def test_equals_brute_force(spark):
    rows = made(random.Random(21))
    docs = frame(spark, [t for _, t in rows], [d for d, _ in rows]).selectExpr("*", "1 AS sig", "2 AS blob", "3 AS copy")
    got = found(docs)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 20


@pytest.mark.parametrize("held", [1, 3000])
def test_what_a_task_settles_itself_changes_nothing(spark, monkeypatch, held):
    rows = made(random.Random(22))
    monkeypatch.setattr(sd, "HELD", held)
    monkeypatch.setattr(sd, "HELD_WINDOWS", held)
    assert found(frame(spark, [t for _, t in rows], [d for d, _ in rows]).coalesce(2)) == brute(rows)


def test_windows_at_every_distance_share_an_anchor():
    rng = random.Random(23)
    window = [b"%d" % rng.randrange(1000) for _ in range(L)]
    for a in range(sd.PERIOD):
        for b in range(sd.PERIOD):
            texts = [[b"left"] * a + window + [b"l"] * 3, [b"right"] * b + window + [b"r"] * 5]
            owner, place, key = sd.anchors(texts)
            common = set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())
            at = place[(owner == 1) & np.isin(key, list(common))]
            assert b in sd.around(at, len(texts[1])).tolist()


def test_texts_that_stay_and_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = {r["doc_id"]: r for r in sd.apply(frame(spark, [text, text, "q " + text[4:], "few words"], [5, 6, 7, 8])).collect()}
    assert [got[i]["n_removed"] for i in (5, 6, 7, 8)] == [0, 30, 28, 0]
    assert (got[7]["begin"], got[7]["end"], got[7]["kept"].split()[0]) == ([2], [30], "q")


def test_empty_table(spark):
    assert sd.report(frame(spark, ["a"]).where("false")).count() == 0


def test_many_documents_share_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat('own', id, ' {passage} ', id * 7)  AS text")
    counts = {(r[0], r[1]) for r in sd.report(docs).groupBy("n_removed").count().collect()}
    assert counts == {(0, 1), (40, 19_999)}
