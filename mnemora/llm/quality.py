"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level to a fixed depth on binned features and stored as
flat arrays (feature, threshold, value) in heap order, so that scoring a batch is
one indexing step per level for all rows and trees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .learning import labelled_sample, sample_matrix, score_documents

THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, L2, LEAF = 60, 4, 64, 0.15, 2.0, 10


def _classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.intp)  # 0: other control bytes
    for name, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"$%&*#@^~+=<>_\\/", b"'\"()[]{}:;-`", range(128, 256)), 1):
        out[list(members)] = name
    return out


CLASS = _classes()
N_CLASSES = 13
N_FEATURES = N_CLASSES - 1 + 13


def statistics(text: str) -> list[float]:
    """Statistics of the whole text; all are zero for an empty one."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    kinds = CLASS[np.frombuffer(raw, dtype=np.uint8)]
    shares = (np.bincount(kinds, minlength=N_CLASSES) / n).tolist()
    words = raw.split()
    w = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    space = (kinds == 4) | (kinds == 5)
    ends = np.flatnonzero(space[1:] & ~space[:-1])
    tail = np.bincount(kinds[ends], minlength=N_CLASSES) if len(ends) else np.zeros(N_CLASSES)
    lengths = np.diff(np.flatnonzero(space), prepend=-1) - 1
    lengths = lengths[lengths > 0]
    same = np.count_nonzero(kinds[1:] == kinds[:-1]) / n
    return [
        *shares[1:], np.log1p(n), np.log1p(len(words)), n / w, distinct / w, np.log(w) * (1 - distinct / w), again / w, nl / w, len(set(lines)) / nl,
        float(tail[10] / w), float(tail[8] / w), float(tail[6] / w), float(lengths.std()) if len(lengths) else 0.0, same,
    ]


class Trees:
    """Boosted trees of one depth as arrays of shape (trees, nodes)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.empty(0)
        trees, inner = self.feature.shape
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.intp)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosts the logistic loss. Without rows, or of one label, a constant near the
    label's rate results (0.5 without rows)."""
    inner = 2**depth - 1
    rate1 = (y.sum() + 1) / (len(y) + 2)
    feature, threshold = np.zeros((trees, inner), dtype=np.intp), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    base = float(np.log(rate1 / (1 - rate1)))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature, threshold, value)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.intp)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            pick = np.zeros((width, 2), dtype=np.intp)
            found = np.zeros(width, dtype=bool)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * BINS + binned[f]
                gs, hs, ns = (np.bincount(key, weights=v, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAF) | (nt - ns < LEAF)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], found[better] = top[better], True
                pick[better] = np.stack([np.full(width, f), at], axis=1)[better]
            for i in np.flatnonzero(found):
                f, b = pick[i]
                feature[t, first + i], threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
        value[t] = -rate * gs / (hs + L2)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value)


def train_quality(docs: DataFrame, labels: DataFrame) -> Trees:
    return fit(*sample_matrix(labelled_sample(docs, labels, "quality"), statistics, N_FEATURES))


def score_quality(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs(doc_id, text)``.

    Null and empty texts are scored as texts without words. Repeated rows score
    alike. An empty table has no rows. With ``keep`` the whole row comes as a struct ``row``.
    """
    return score_documents(docs, statistics, train_quality(docs, labels).predict, THRESHOLD, keep)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns as they are,
    whatever they are called. Null and empty texts are judged as texts without words, equal
    texts alike; an empty table has no rows."""
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=True).where(F.col("predicted") == 1).select("row.*")
