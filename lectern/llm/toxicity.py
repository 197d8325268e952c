"""Operator 8: toxicity by non-negative positive-unlabelled learning.

A linear classifier over word presence is trained in numpy from confirmed toxic examples and
unlabelled text. The risk on negatives is that of the unlabelled rows less the class prior's
share of positives; where that estimate falls below zero, the step goes the other way, so the
model can't drive it there by fitting the positives alone.

The samples are bounded: at most ``POSITIVES`` confirmed toxic rows of the training folds and
``UNLABELLED`` rows of those folds whatever their label, each those with the smallest hash of
doc_id. The class prior is the toxic share of the labelled training rows. Features are the
words, and beginnings of words, that are significantly more frequent in the positives,
``FEATURES`` at most; they are chosen by counting in Spark, and only they come to the driver.
Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.

Defined results: null and empty texts have no words and get the score of the bias. Rows with
a null label are not learnt from; repeated labels and documents count once in training and
repeated documents are scored row by row. Without positives every score is 0. A null doc_id
is not held out. Labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, materialise
from lectern.llm.labelled import remainder, sample, texts_of

POSITIVES, UNLABELLED, FEATURES = 3_000, 9_000, 800
FOLDS, HELD = 3, 1
#: Lengths, in characters, of the beginnings of words that are features beside the words. More of them catch more and mark clean texts too.
BEGINNINGS = (5,)
CUT = 0.7
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> set[bytes]:
    return set(WORD.findall(text.encode("utf-8", "surrogatepass").lower()))


def parts(word: bytes) -> list[int]:
    """The hashes of a word and of its beginnings, so that inflected and compound forms have something in common."""
    letters = word.decode("utf-8", "replace")
    return [zlib.crc32(word), *(zlib.crc32(b"^" + letters[:n].encode()) for n in BEGINNINGS if n < len(letters))]


def hashed(text: str) -> np.ndarray:
    """The sorted hashes of a text's words and their beginnings."""
    return np.unique(np.array([h for w in words(text) for h in parts(w)], dtype=np.int64))


@dataclass
class Linear:
    bias: float = -30.0
    weight: dict[int, float] = field(default_factory=dict)  # by the hash of a word

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        cache: dict[bytes, tuple[int, ...]] = {}  # a word's hashes that have a weight: of most words none
        for i, text in enumerate(texts):
            found: set[int] = set()
            for w in words(text):
                if w not in cache:
                    cache[w] = tuple(h for h in parts(w) if h in self.weight)
                if cache[w]:
                    found.update(cache[w])
            total[i] += sum(self.weight[h] for h in sorted(found))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> np.ndarray:
    """Hashes of words whose share of the positives is over that of the unlabelled rows by four standard errors and more."""
    ids, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *positive]), return_counts=True)
    others, other_counts = np.unique(np.concatenate([np.zeros(0, np.int64), *unlabelled]), return_counts=True)
    at = np.minimum(np.searchsorted(others, ids), max(0, len(others) - 1))
    there = np.where(others[at] == ids, other_counts[at], 0) if len(others) else np.zeros(len(ids))
    p, u = counts / max(1, len(positive)), (there + 1) / (len(unlabelled) + 2)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / max(1, len(positive)) + 1 / max(1, len(unlabelled))))
    fine = np.flatnonzero((z >= 4) & (counts >= 4))
    return np.sort(ids[fine[np.argsort(-z[fine], kind="stable")][:most]])


def design(rows: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    return np.array([np.isin(vocabulary, r) for r in rows], dtype=np.float64).reshape(len(rows), len(vocabulary))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """Adam on the non-negative risk with the logistic loss."""
    if not positive or not unlabelled or prior <= 0:
        return Linear()
    vocabulary = select(positive, unlabelled, FEATURES)
    xp, xu = design(positive, vocabulary), design(unlabelled, vocabulary)
    w = np.zeros(len(vocabulary) + 1)
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 5.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        gp, gu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp_plus = -(1 - sigmoid(gp)) / len(gp) * prior
        dp_minus, du_minus = sigmoid(gp) / len(gp) * prior, sigmoid(gu) / len(gu)
        if negative >= 0:
            dp, du = dp_plus - dp_minus, du_minus
        else:  # the estimate is below zero: undo that part alone
            dp, du = dp_minus, -du_minus
        grad = np.r_[xp.T @ dp + xu.T @ du, dp.sum() + du.sum()] + decay * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Linear(float(w[-1]), dict(zip(vocabulary.tolist(), w[:-1].tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame) -> Linear:
    learnt = labels.select("doc_id", "toxic").where("toxic IS NOT NULL").where(remainder(FOLDS) != HELD)
    prior = learnt.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0

    def written(rows: DataFrame, name: str) -> DataFrame:
        return materialise(map_texts(texts_of(docs, rows), "text", lambda texts: {"h": [hashed(t) for t in texts]}, "h array<bigint>", ["doc_id"]), name)

    sides = [written(sample(learnt.where("toxic = 1").select("doc_id"), POSITIVES), "positives"), written(sample(docs.select("doc_id").where(remainder(FOLDS) != HELD), UNLABELLED), "unlabelled")]
    chosen = telling(*sides)

    def collected(side: DataFrame) -> list[np.ndarray]:
        # Only the chosen hashes come to the driver.
        kept = side.select("doc_id", F.array_intersect("h", F.from_json(F.lit(json.dumps(chosen)), "array<bigint>")).alias("h"))
        return [np.array(h, dtype=np.int64) for h in kept.orderBy("doc_id").toPandas()["h"]]

    positive, unlabelled = map(collected, sides)
    return fit(positive, unlabelled, prior)


def telling(positive: DataFrame, unlabelled: DataFrame, most: int = FEATURES) -> list[int]:
    """The hashes that ``select`` would choose, found by counting in Spark."""
    n = positive.count(), unlabelled.count()
    if not all(n):
        return []
    counted = lambda side, name: side.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias(name))
    both = counted(positive, "c").where("c >= 4").join(counted(unlabelled, "d"), "h", "left").fillna(0, ["d"])
    p, u = F.col("c") / n[0], (F.col("d") + 1) / (n[1] + 2)
    z = (p - u) / F.sqrt(u * (1 - u) * (1 / n[0] + 1 / n[1]))
    return [r["h"] for r in both.withColumn("z", z).where("z >= 4").orderBy(F.desc("z"), "h").limit(most).collect()]


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = map_texts(docs.select("doc_id", "text"), "text", lambda texts: {"score": model.score(texts)}, "score double", ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder(FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
