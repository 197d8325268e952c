import random
import time
from collections import defaultdict

from lectern.llm import line_dedup
from tests.llm.helpers import WORD, frame


def brute(texts):
    places = defaultdict(list)
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            if WORD.search("".join(lines[i : i + 3])):
                places[tuple(lines[i : i + 3])].append((d, i))
    gone = defaultdict(set)
    for found in places.values():
        for d, i in sorted(found)[1:]:
            gone[d] |= {i, i + 1, i + 2}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) if t else t for d, t in enumerate(texts)}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a\nb", "\n\n\n\n", "z\n" * 50, "a\nb\nc\nd", "x\na\nb\nc\nd\ny"]
    texts += ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    out = {r["doc_id"]: r["left"] for r in line_dedup.apply(frame(spark, texts)).select("row.doc_id", "left").collect()}
    assert out == brute(texts)


def test_clean_keeps_columns_nulls_and_repeated_rows(spark):
    docs = frame(spark, ["a\nb\nc", "q\na\nb\nc", "a\nb\nc", None, "a\nb\nc"], [1, 2, 1, 3, None]).selectExpr("*", "7 AS pos", "8 AS gone")
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"] or 0) for r in out.collect()) == [(0, "a\nb\nc", 5), (1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (2, "q", 1), (3, "", 0)]
    assert line_dedup.clean(docs.where("false")).count() == 0


def test_first_place_of_every_line_stays(spark):
    texts = ["h\na\nb\nc\nt", "a\nb\nc\nd", "b\nc\nd\ne", "a\nb\nc\nd\ne"]
    out = [r["left"] for r in line_dedup.apply(frame(spark, texts)).collect()]
    assert set("habctde") <= set("".join(out))


def test_very_many_removed_lines_in_one_text(spark):
    lines = [f"l{i}" for i in range(100_000)]
    text = "\n".join(x for i in range(0, 100_000, 4) for x in (*lines[i : i + 3], f"own{i}"))
    other = "\n".join(x for i in range(0, 100_000, 4) for x in (*lines[i : i + 3], f"other{i}"))
    begin = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.report(frame(spark, [other, text])).collect()}
    assert got == {0: (100_000, 0), 1: (100_000, 75_000)}
    assert time.time() - begin < 30


def test_windows_that_most_documents_share_are_salted(spark):
    texts = [f"{i}\na\nb\nc\nd{i}" for i in range(1500)]
    got = line_dedup.report(frame(spark, texts)).where("n_removed = 3").count()
    assert got == 1499


def test_repeated_doc_ids_lose_no_line_of_their_own(spark):
    texts = ["x1\nx2\nx3\nq", "x1\nx2\nx3\nz", "u1 only\nu2 only\nu3 only\nu4 only", "u1 only\nu2 only\nu3 only\nv"]
    docs = frame(spark, texts, [1, 2, 2, 3])
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.clean(docs).collect())
    assert got == [(1, texts[0]), (2, texts[2]), (2, "z"), (3, "v")]
    # Two texts of one doc_id share lines: these stay in one of them.
    both = line_dedup.clean(frame(spark, ["s1\ns2\ns3\na", "b\ns1\ns2\ns3"], [5, 5])).collect()
    assert sorted(x for r in both for x in r["text"].split("\n")) == ["a", "b", "s1", "s2", "s3"]
