"""Search: published stems, the query forms, and a stored index that follows its texts."""

import math
import random
import re

import pytest

from lectern.operators import search
from lectern.sources.store import NotFound, Store

# Words and stems that the algorithm's description gives.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_published_stems(word, stem):
    assert search.stem(word) == stem


def test_forms_of_a_word_meet():
    for forms in ("run running runs", "company companies", "terminate terminated terminating termination", "Läufe laufe LAUFES"):
        assert len({search.terms(w)[0] for w in forms.split()}) == 1


def test_queries():
    clause = search.Clause
    assert search.clauses('"Halloran Instruments, Inc." OR run* NOT "a b" x-y, AND') == [[clause(("halloran", "instrument", "inc"))], [clause(("run",), True), clause(("a", "b"), False, False), clause(("x", "y"))]]
    assert search.clauses('NOT gone') == search.clauses('" , "') == search.clauses("") == []


def brute(rows, query):
    """{key: (score, n, first)} by looking through every text."""
    held = {k: search.terms(t or "") for k, t in rows}
    asked = search.clauses(query)
    average = sum(map(len, held.values())) / len(held)

    def places(words, c):
        fits = lambda w, j: w.startswith(c.terms[j]) if c.prefix and j == len(c.terms) - 1 else w == c.terms[j]
        return [i for i in range(len(words) - len(c.terms) + 1) if all(fits(words[i + j], j) for j in range(len(c.terms)))]

    every = dict.fromkeys(c for a in asked for c in a if c.wanted)
    idf = {}
    for c in every:
        n = sum(bool(places(w, c)) for w in held.values())
        idf[c] = max(math.log((len(held) - n + 0.5) / (n + 0.5)), 0) or search.LEAST_IDF
    out = {}
    for k, words in held.items():
        if any(all(bool(places(words, c)) == c.wanted for c in a) for a in asked):
            f = {c: places(words, c) for c in every}
            score = sum(idf[c] * len(p) * 2.2 / (len(p) + 1.2 * (0.25 + 0.75 * len(words) / average)) for c, p in f.items())
            out[k] = (round(score, 6), sum(map(len, f.values())), min(p[0] for p in f.values() if p))
    return out


QUERIES = ["running", "run company", '"companies run"', "terminat*", '"the comp*"', "company NOT run", "runs OR terminated", '"a, B" NOT the', "nothing", 'the', '"run run"']


def texts(rng, n):
    words = ["run", "Running", "companies", "Company", "terminated", "the", "a", "b", "é", "terminator"]
    return [" ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def found(df):
    return {r["k"]: (round(r["score"], 6), r["n"], r["first"]) for r in df.collect()}


def test_search_equals_looking_through_every_text(spark):
    rng = random.Random(8)
    rows = list(enumerate([None, "", *texts(rng, 40)]))
    docs = spark.createDataFrame(rows, "k long, text string").repartition(3)
    for query in QUERIES:
        assert found(search.search(docs, query, ["k"])) == brute(rows, query), query


def test_a_stored_index_follows_its_texts(spark, tmp_path):
    rng = random.Random(9)
    index = search.Index(Store(spark, f"file://{tmp_path}/store"), "pages", ["k"])
    with pytest.raises(NotFound, match="not indexed"):
        index.search("run")
    state = dict(enumerate(texts(rng, 20)))
    frame = lambda s: spark.createDataFrame([*s.items()], "k long, text string")
    check = lambda qs: [found(index.search(q)) == brute([*state.items()], q) for q in qs]
    assert index.add(frame(state)) == 20
    version = index.store.version()
    assert index.add(frame(state)) == 0
    assert index.store.version() == version  # a second time is no work
    assert all(check(["running", '"companies run"', "nothing"]))
    new = {3: "Companies run here", 40: "running companies run", 41: None}
    assert index.add(frame(new)) == 2
    state |= {k: t for k, t in new.items() if t}
    assert all(check(["running", '"companies run"', "here"]))
    assert index.remove(frame({5: None, 77: None})) == 1
    del state[5]
    assert all(check(["the", '"run comp*"']))
    index.compact()
    assert all(check(["the", '"run comp*"', "running"]))
    hits = index.search("run companies", 2)
    assert [r["k"] for r in hits.collect()] == [k for k, _ in sorted(brute([*state.items()], "run companies").items(), key=lambda x: (-x[1][0], x[0]))][:2]
    told = search.with_snippets(hits, frame(state), ["k"]).collect()
    assert all("run" in search.terms(r["snippet"]) for r in told)


def test_a_query_reads_only_its_terms(spark, tmp_path):
    index = search.Index(Store(spark, f"file://{tmp_path}/store"), "pages", ["k"])
    index.add(spark.range(200).selectExpr("id AS k", "concat('common w', id) AS text"))
    rows = index.store.table("pages_postings").where(search.looked_up([c for a in search.clauses("w17") for c in a]))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w17)]" in rows._jdf.queryExecution().toString()
    assert found(index.search("w17"))[17][1] == 1


def test_expired_versions_leave_no_file(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    frame = spark.createDataFrame([(1, "secret words"), (2, "plain")], "k long, text string")
    store.insert("pages", frame)
    store.insert("pages", spark.createDataFrame([(3, "more")], "k long, text string"))
    reader = store.table("pages")
    assert reader.count() == 3
    store.rewrite({"pages": lambda p: p.where("k <> 1")})
    assert sorted(r["k"] for r in store.table("pages").collect()) == [2, 3]
    import pyarrow.parquet as pq

    left = [r for f in tmp_path.rglob("*.parquet") for r in pq.read_table(f)["text"].to_pylist()]
    assert sorted(left) == ["more", "plain"]
    assert len([*tmp_path.glob("store/_log/*.json")]) == 1
    store.insert("pages", frame.where("k = 2"))
    assert store.expire(keep=2) == 0
    assert store.table("pages", version=store.version() - 1).count() == 2


def test_texts_that_spark_reads_are_found_as_python_finds_them(spark):
    rng = random.Random(10)
    words = ["Run", "running", "runs", "RÜN", "rünn", "ru", "rub", "licensed", "Licenses", "licens", "été", "ETE", "naïve", "x_run", "run_x", "77", "77s", "7", "a77ing", "a7", "ﬁx", "İstanbul", "istanbul", "ΣΑΣ", "ς", "ruńs", "中文", "sensibility", "sensible", "sensibl", "½run", "run²", "ß", "K", "run’s", " run", "éte", "ｒｕｎ", "हि", "𝒳run", "ability", "able"]
    docs = [(0, None), (1, "")] + [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "\n", "’", " "]) for _ in range(rng.randint(1, 9)))) for i in range(2, 400)] + [(3, "run again"), (None, "runs")]
    frame = spark.createDataFrame(docs, "k long, text string").repartition(2)
    for query in [*QUERIES, "77", "a7", "licens", "ete", "sensible", "sensi*", "r*", "able OR ru", '"run s"', "istanbul", "run² NOT ru*", "ßs OR 中文", "naive", "7*", "abl*"]:
        asked = [c for a in search.clauses(query) for c in a]
        whole, beginnings = search.asked_terms(asked)
        told = lambda rows: sorted(((str(r["k"]), r["term"], p, r["length"]) for r in rows for p in r["at"]))
        got = told(search.asked_postings(frame, ["k"], "text", asked).collect())
        want = sorted((str(k), t, i, len(ts)) for k, text in docs for ts in [search.terms(text or "")] for i, t in enumerate(ts) if t in whole or t.startswith(beginnings))
        assert got == want, query
    # Python is given no text that Spark can fold, and no word that can have no asked stem.
    plan = search.asked_postings(frame.where("k IS NOT NULL"), ["k"], "text", [search.Clause(("part",))])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("octet_length") == 3


def test_no_word_but_those_of_the_pattern_has_the_stem():
    rng = random.Random(11)
    ends = [*search.STEP_1A, *search.STEP_2, *search.STEP_3, "ed", "ing", "y", "e", "able", "ity", "ly", "eed", "ll", "ment", "ator", "bling"]
    for _ in range(20_000):
        word = "".join(rng.choice("aeioubstlzxy7ßdr") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 4)))
        stem = search.stem(word)
        assert re.fullmatch(search.stemmed_to(stem), word), word
        assert all(re.fullmatch(search.begun_with(stem[:n]), word) for n in range(1, len(stem) + 1)), word
