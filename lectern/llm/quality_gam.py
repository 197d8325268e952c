"""Operator 4: a quality classifier, a generalised additive model with pairwise interactions.

Shape functions are lookup tables over the bins of each feature. Boosting visits the features
in turn, round by round; each visit fits a tree of at most three leaves to the gradients of
the logistic loss by bin and adds a small share of it to that feature's table. The strongest
pairs, by the gain of a four-leaf tree on what is left, then get tables over two features'
bins in the same way. A score is the sum of table entries, looked up for whole batches.

Fitted on at most ``SAMPLE`` labelled rows outside the held-out fold (those with the smallest
hash of doc_id); features come from the text alone: byte classes, words, lines, repetition.

Defined results: null and empty texts have all features zero and are scored like any other.
Rows with a null label, and labels without a document, are not learnt from; repeated labels
of a document count once, repeated documents are scored row by row. Without any labelled row
every score is 0.5, and with labels of one kind it is close to that label. A null doc_id is
not held out. Labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_texts
from lectern.llm.labelled import remainder, sample, texts_of

SAMPLE = 20_000
FOLDS, HELD = 5, 0
CUT = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
#: Byte classes whose shares are features.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b".,;:?", b"#*$%&<>", b"|", b"\"'()[]{}", b"@/\\_=+-~^`", b" ", b"\n", bytes(range(128, 256))]


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (len(CLASSES) + 9)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts / len(raw)
    used = share[share > 0]
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64)
    return [float(share[list(c)].sum()) for c in CLASSES] + [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        len(set(words)) / len(words),
        len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        len(set(lines)) / len(lines),
        len(raw) / len(lines),
        float(-(used * np.log2(used)).sum()),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(CLASSES) + 9)


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of bins into left and right, and the first bin on the right."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = gain(gl, hl) + gain(g.sum() - gl, h.sum() - hl) - gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of at most three leaves, by bin."""
    _, cut = best_cut(g, h)
    cuts = [0, cut, len(g)] if cut else [0, len(g)]
    if cut:
        (left, a), (right, b) = best_cut(g[:cut], h[:cut]), best_cut(g[cut:], h[cut:])
        more = a if left >= right else cut + b
        if max(left, right) > 0 and more not in cuts:
            cuts = sorted({*cuts, more})
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and values of a tree that cuts the first feature, then the second on each side."""
    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        total, table = 0.0, np.empty_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            gp, hp = g[part].sum(axis=0), h[part].sum(axis=0)
            more, at = best_cut(gp, hp)
            total += more + gain(gp.sum(), hp.sum())
            table[part, :at], table[part, at:] = leaf(gp[:at].sum(), hp[:at].sum()), leaf(gp[at:].sum(), hp[at:].sum())
        if total > best:
            best, values = total, table
    return best - float(gain(g.sum(), h.sum())), values


@dataclass
class Gam:
    """Tables over bins: base + sum of singles + sum of pairs, in log-odds."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    singles: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.singles):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.15) -> Gam:
    if not len(y):
        return Gam()
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    edges = lambda col, n: np.unique(np.quantile(col, np.arange(1, n) / n))
    model = Gam(float(np.log(mean / (1 - mean))), [edges(c, BINS) for c in x.T], [], [edges(c, PAIR_BINS) for c in x.T])
    binned = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(x.shape[1])]
    model.singles = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, bins in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            n = len(model.singles[j])
            step = rate * shallow_tree(np.bincount(bins, y - p, n), np.bincount(bins, p * (1 - p), n))
            model.singles[j] += step
            total += step[bins]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def tree(i: int, j: int) -> tuple[float, np.ndarray]:
        p, cell, shape = 1 / (1 + np.exp(-total)), coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        return pair_tree(np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((tree(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * tree(i, j)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Gam:
    rows = sample(labels.select("doc_id", "quality").where("quality IS NOT NULL").where(remainder(FOLDS) != HELD), most)
    made = map_texts(texts_of(docs, rows), "text", lambda texts: {"x": list(matrix(texts))}, "x array<double>", ["doc_id", "quality"])
    found = made.orderBy("doc_id").toPandas()
    return fit(np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(CLASSES) + 9), found["quality"].to_numpy(dtype=np.float64))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = map_texts(docs.select("doc_id", "text"), "text", lambda texts: {"score": model.score(matrix(texts))}, "score double", ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder(FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
