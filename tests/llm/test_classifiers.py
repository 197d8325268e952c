import math
import random
import zlib

import numpy as np

from lectern.llm import quality_gam, toxicity
from tests.llm.helpers import frame

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=300):
    rng = random.Random(14)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Scum", "vermin,"])
        texts.append(" ".join(w + "$$$" if bad and rng.random() < 0.7 else w for w in words))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, [*texts, None, "", texts[0]], [*range(n), 900, 901, None]), spark.createDataFrame([*labels, labels[0], (7000, 1, 0), (900, None, None)], LABELS)


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def check_contract(rows, n, modulus, held, cut):
    assert len(rows) == n
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = quality_gam.scores(docs, labels).collect()
    check_contract(rows, 303, 5, 0, 0.3)
    assert accuracy(rows, {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.scores(docs, labels).collect()
    check_contract(rows, 303, 3, 1, 0.7)
    assert accuracy(rows, {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}) > 0.95


def test_without_labels_and_without_rows(spark):
    docs, labels = corpus(spark, 20)
    none = labels.where("false")
    assert {r["score"] for r in quality_gam.scores(docs, none).collect()} == {0.5}
    assert all(r["predicted"] == 0 for r in toxicity.scores(docs, none).collect())
    for scores in (quality_gam.scores, toxicity.scores):
        assert scores(docs.where("false"), labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(spark, 120)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality", "if(crc32(cast(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    for scores in (quality_gam.scores, toxicity.scores):
        assert sorted((r["doc_id"] or -1, r["score"]) for r in scores(docs, labels).collect()) == sorted((r["doc_id"] or -1, r["score"]) for r in scores(docs, flipped).collect())


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(15)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(16)
    positive = [np.array([1, *rng.integers(10, 10_000, 5)]) for _ in range(100)]
    unlabelled = [np.array(sorted({1 if rng.random() < 0.1 else 2, *rng.integers(10, 10_000, 5).tolist()})) for _ in range(1000)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert model.weight[1] > 0 and max(abs(w) for w in model.weight.values()) < 50


def test_additive_scores_equal_plain_lookups():
    rng = np.random.default_rng(17)
    x = rng.random((400, 4))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=5)

    def cell(cuts, value):
        return sum(c <= value for c in cuts)

    for row, score in zip(x[:60], model.score(x[:60]), strict=True):
        total = model.base + sum(t[cell(c, v)] for t, c, v in zip(model.singles, model.cuts, row, strict=True))
        total += sum(t[cell(model.pair_cuts[i], row[i]), cell(model.pair_cuts[j], row[j])] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


def test_linear_scores_equal_plain_sums():
    texts = ["Scum of the earth", "a kind word", "", "vermin, vermin!"]
    weight = {int(h): 0.5 + i for i, h in enumerate(toxicity.hashed("scum vermin earth kind"))}
    model = toxicity.Linear(-1.0, weight)
    expected = [1 / (1 + math.exp(-(-1.0 + sum(weight.get(int(h), 0.0) for h in toxicity.hashed(t))))) for t in texts]
    assert np.allclose(model.score(texts), expected)


def test_repeated_labels_of_other_values_give_the_same_model(spark):
    docs, labels = corpus(spark, 80)
    twice = labels.union(labels.selectExpr("doc_id", "1 - quality", "toxic").limit(40))
    runs = [sorted((r["doc_id"] or -1, r["score"]) for r in quality_gam.scores(docs, twice.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
