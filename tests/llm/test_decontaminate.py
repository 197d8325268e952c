import random
import re

import pytest

from lectern.llm import decontaminate
from tests.llm.helpers import frame


def brute(docs, items):
    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in docs.items()}
    wanted = {i: s for i, t in items.items() if (s := shingles(t))}
    return sorted((d, i, len(s & sets[d]) / len(s)) for d in docs for i, s in wanted.items() if len(s & sets[d]) / len(s) >= 0.8 - 1e-9)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    word = lambda: rng.choice(["Épée", "a", "bb", "c1", "dd", "x,y", "Z."]) + str(rng.randint(0, 30))
    items = {i: " ".join(word() for _ in range(rng.randint(1, 60))) for i in range(20)} | {50: None, 51: "", 52: "..."}
    docs = {100: None, 101: "", 102: "!!!"}
    for i in range(60):
        part = items[rng.randrange(20)].split(" ")
        if rng.random() < 0.6:
            part[rng.randrange(len(part))] = "other"
        docs[i] = " ".join([word() for _ in range(rng.randint(0, 3000))] + [p.upper().replace("É", "É") if rng.random() < 0.1 else p for p in part] + ["end"])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(frame(spark, list(docs.values()), list(docs)), bench).collect())
    assert got == brute(docs, items)
    assert got


def test_clean(spark):
    item = "one two three four five six seven eight nine ten"
    docs = frame(spark, [f"x {item} y", "clean text here", None, item, item], [1, 2, 3, None, 1]).selectExpr("*", "5 AS item_id", "6 AS h")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (None, "clean text here", 0)], "item_id long, text string, n int")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [2, 3]  # texts decide: the contaminated row without a doc_id goes too
    assert decontaminate.clean(docs, bench.where("false")).count() == 5
    assert decontaminate.matches(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_short_items_in_long_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    items = {1: "Needle", 2: "two, words", 4: "four of these words", 6: "one two three four five six", 7: "no such words"}
    docs = {10: "x " * 50 + "NEEDLE y " + "x " * 50, 11: "a b c d e two words f", 12: "says four of these words and more", 13: "needle", 14: "needles two x words", 15: "z one two three four five six needle", 16: "two words"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(frame(spark, list(docs.values()), list(docs)), bench).collect())
    assert got == [(10, 1, 1.0), (11, 2, 1.0), (12, 4, 1.0), (13, 1, 1.0), (15, 1, 1.0), (15, 6, 1.0), (16, 2, 1.0)]
