import math
import random
from collections import Counter

from lectern.llm import quality_rules
from tests.llm.helpers import SCHEMA, WORD, frame


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "a\nb\na\n a\n\n", "x y   z é𝒳 #*", "one " * 4000, "|<>&%$*# " * 30]
    texts += [rng.choice([" ", "\n", "\t"]).join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(str(i) for i in range(20_000)) + " 0 1 2 3 4 5"]
    got = {r["doc_id"]: r for r in quality_rules.report(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text
        assert not (r["base_failed"] and r["kept"])


def test_limits_follow_each_source(spark):
    plain = [" ".join(f"word{i}{j}" for j in range(30)) for i in range(80)]
    tables = [" | ".join(f"cell{i}{j}" for j in range(30)) for i in range(80)]
    noisy = " ".join(f"w{j}###" for j in range(30))
    data = [(i, t, "en", "web", 0) for i, t in enumerate(plain)] + [(100 + i, t, "en", "tables", 0) for i, t in enumerate(tables)]
    data += [(900, noisy, "en", "web", 0), (901, tables[0], "en", "tables", 0), (902, plain[0], None, None, 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not kept.pop(900)
    assert all(kept.values())


def test_empty_table_and_clashing_columns(spark):
    empty = frame(spark, ["x"]).where("false")
    assert quality_rules.report(empty).count() == 0
    docs = frame(spark, [" ".join(map(str, range(20))), "few"]).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS _q_lang2", "4 AS h")
    out = quality_rules.keep(docs)
    assert out.columns == docs.columns
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_small_groups_take_the_limits_of_their_language(spark):
    plain = [" ".join(f"word{i}{j}" for j in range(30)) for i in range(60)]
    noisy = [t.replace("word", "wo##") for t in plain]
    few = [(i, t, "en", "few", 0) for i, t in enumerate(noisy[:5])]
    docs = few + [(100 + i, t, "en", "web", 0) for i, t in enumerate(plain)]
    measured = quality_rules.measure(spark.createDataFrame(docs, SCHEMA))
    limits = lambda least: {r["q_source"]: r["symbols_most"] for r in quality_rules.thresholds(measured, least).collect()}
    assert limits(50)["few"] is not None and limits(50)["web"] is None
    assert limits(50)["few"] < limits(1)["few"]  # by themselves all of them have symbols, in the language few have


def brute_kept(rows, min_group=50):
    """kept by plain code; sketches of so few rows hold every value."""

    def measures(text):
        n, chars, symbols, dup, repeat, failed = brute(text)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return {"n": n, "failed": failed, "symbols": symbols / max(1, chars), "dup_lines": dup / max(1, len(lines)), "repeat_share": repeat / max(1, n), "word_length": chars / n if n else None, "log_words": math.log(n) if n else None}

    told = [(lang, source, measures(text)) for _, text, lang, source, _ in rows]
    held = [x for x in told if x[2]["n"]]

    def quantile(values, q):
        return sorted(values)[max(1, math.ceil(q * len(values) - 1e-9)) - 1] if values else None

    def verdict(lang, source, m):
        own = [x for x in held if x[:2] == (lang, source)]
        own = [x[2] for x in (own if len(own) >= min_group else [x for x in held if x[0] == lang])]
        if m["failed"]:
            return False

        def around(values, factor):
            q1, q3 = quantile(values, 0.25), quantile(values, 0.75)
            width = factor * max(q3 - q1, quality_rules.NARROW * q3)
            return q1 - width, q3 + width

        for name, q, factor in quality_rules.RARE:
            some = [x[name] for x in own if x[name]]
            if some and m[name] > max(factor * quantile(some, q), around([x[name] for x in own], quality_rules.WIDE)[1]):
                return False
        for name, factor in quality_rules.SPREAD:
            low, high = around([x[name] for x in own], factor)
            if not low <= m[name] <= high:
                return False
        return True

    return {r[0]: verdict(*x) for r, x in zip(rows, told, strict=True)}


def mixed_rows(seed=5):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(a, b)))
    rows = []
    for i in range(240):
        source = rng.choice(["web", "web", "books", "few"])
        words = [word(2, 9) for _ in range(rng.randint(5, 120))]
        kind = rng.random()
        if kind < 0.08:
            words = [w + rng.choice(["#", "|", "##"]) for w in words]
        elif kind < 0.12:
            words = [word(18, 30) for _ in words]
        elif kind < 0.2:
            words += words[:6]
        text = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words) + ("\n".join(["same line here"] * rng.randint(0, 3)))
        rows.append((i, None if i == 7 else text, rng.choice(["en", "en", None]), source, 0))
    return rows


def test_verdicts_equal_plain_quantiles(spark):
    rows = mixed_rows()
    got = {r["doc_id"]: r["kept"] for r in quality_rules.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = brute_kept(rows)
    assert got == expected
    assert 100 < sum(got.values()) < 230
    assert sorted(r["doc_id"] for r in quality_rules.keep(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(i for i, k in expected.items() if k)
