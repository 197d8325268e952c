import random
from itertools import combinations

from pyspark.sql import functions as F

from lectern.operators import entities, likeness


def expected_names(names, least=80.0):
    return {(a, b): likeness.indel_ratio(a, b) for a, b in combinations(sorted(names), 2) if likeness.indel_ratio(a, b) >= least and entities.could_be_one(a, b)}


def test_near_words_are_all_found(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"ab", "abc", "abcd", "x" * 40, "x" * 39 + "y", "é𝒳é", "é𝒳éé"}
    got = [(r["word"], r["near"]) for r in likeness.near_words(spark.createDataFrame([(w,) for w in words], "word string"), 85.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a != b and likeness.indel_ratio(a, b) >= 85}


def test_near_names_with_frequent_words_dealt_to_many_tasks(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["smith", "smyth", "smiths", "holding", "holdings", "the", "ltd", "limited", "limitd", "a", "j", "q", "instruments", "instrument", "north", "norths", "é", "straße"]
    names = {" ".join(sorted(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))) for _ in range(400)} | {"!", "ab", "a b", "b c", "a-b c"}
    df = spark.createDataFrame([("T", n) for n in names], "type_id string, name string")
    want = expected_names(names)
    assert len(want) > 100
    for most in (5_000, 7):
        monkeypatch.setattr(likeness, "PER_TASK", most)
        rows = entities.near_name_pairs(df).collect()
        got = {(r["name"], r["other_name"]): r["score"] for r in rows}
        assert len(rows) == len(got)
        # The join may keep pairs that only have near spellings by a wider measure; the names decide.
        assert {k: v for k, v in got.items() if entities.could_be_one(*k)} == want


def test_no_names_and_no_telling_names(spark):
    none = spark.createDataFrame([], "type_id string, name string")
    assert entities.near_name_pairs(none).count() == 0
    plain = spark.createDataFrame([("T", "a b"), ("T", "ab"), ("T", "a b ltd"), ("U", "a b"), ("U", "the of")], "type_id string, name string")
    assert {(r["type_id"], r["name"], r["other_name"]) for r in entities.near_name_pairs(plain).collect()} == {("T", "a b", "ab")}


def test_classes_of_names_have_one_row_for_each_other_class(spark):
    pages = [(f"p{i}", "T", "Anna Smith", None) for i in range(30)] + [("q", "T", "Anna B. Smith", None), ("r", "T", "Smith Anna", None), ("gone", "T", "Ana Smith", "q"), ("n", "T", None, None)]
    got = entities.duplicate_names(spark.createDataFrame(pages, "entity_id string, type_id string, canonical_name string, merged_into string")).collect()
    assert [tuple(r) for r in got] == [("T", "anna b. smith", "anna smith", 1, 31, "initials", 200 * 10 / 23)]


def test_compared_pairs_grow_less_than_with_the_square(spark):
    rng = random.Random(10)

    def compared(n):
        syllables = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]
        names = {f"{rng.choice(syllables)} {rng.choice(syllables)}" for _ in range(n)}
        df = spark.createDataFrame([("T", x) for x in names], "type_id string, name string")
        words = df.select("type_id", "name", F.explode(entities.words_of("name")).alias("w")).select("type_id", "name", "w.*")
        return likeness.word_candidates(words, 80.0, 85.0).distinct().count() / len(names) ** 2

    assert compared(1200) < 0.6 * compared(300)


def test_registered_duplicate_names_equal_a_plain_pass(spark):
    from lectern.plans import catalogue
    from lectern.sources.views import view

    sf = "/root/testdata/sf0.001"
    classes = {}
    for r in view(spark, sf, "clients").select("segment", "name").collect():
        name = " ".join(sorted((r["name"] or "").lower().split()))
        if name:
            classes.setdefault((r["segment"] or "", name), []).append(r["name"])
    want = set()
    for (s, a), (t, b) in combinations(sorted(classes), 2):
        if s == t and likeness.indel_ratio(a, b) >= 80 and entities.could_be_one(a, b):
            basis = "initials" if entities.initials_differ(min(classes[s, a]), min(classes[t, b])) else "similar"
            want.add((s, a, b, len(classes[s, a]), len(classes[t, b]), basis, likeness.indel_ratio(a, b)))
    got = [tuple(r) for r in catalogue.queries()["duplicate_names"](spark, sf).collect()]
    assert len(got) == len(want)
    assert set(got) == want
