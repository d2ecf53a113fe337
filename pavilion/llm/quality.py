"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .common import crc_mod, labelled_sample, map_texts, texts

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Score from which a document counts as good.
THRESHOLD = 0.7


@dataclass
class Forest:
    """Complete binary trees in arrays: node i has the children 2i+1 and 2i+2; x > threshold goes right."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all trees and rows go down one level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node, every = np.zeros((len(x), trees), np.int64), np.arange(trees)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (np.take_along_axis(x, self.feature[every, node], 1) > self.threshold[every, node])
        return 1 / (1 + np.exp(-(self.base + self.value[every, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Boosted trees on histograms of the log-loss gradients.  Without both labels the score is the labels' smoothed mean."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    inner = 2 ** depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    limit = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        limit[f, :len(e)] = e
    cell = binned + np.arange(width) * bins
    logit = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            flat = (cell + ((node - first) * width * bins)[:, None]).ravel()
            sums = [np.bincount(flat, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least) | np.isinf(limit)[None]] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                if gain.reshape(count, -1)[k, best[k]] > 1e-9:
                    feature[t, first + k], at = divmod(int(best[k]), bins)
                    threshold[t, first + k] = limit[feature[t, first + k], at]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        logit += value[t][leaf]
    return Forest(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, **how) -> Forest:
    """A model for ``labels.quality`` from labelled ids whose crc32 modulo 4 is not 2; texts are the only input."""
    rows = labelled_sample(docs, labels, "quality", crc_mod(F.col("doc_id"), 4) != 2, max_rows)

    def run(batch):
        got = np.array([stats.measure(t) for t in texts(batch)], np.int64).reshape(-1, len(stats.COUNTS))
        return {"label": batch.column("label")} | {c: got[:, k] for k, c in enumerate(stats.COUNTS)}

    names = ["label", *stats.COUNTS]
    got = map_texts(rows, ["text", "label"], run, ", ".join(f"{c} long" for c in names)).toPandas().to_numpy(np.int64)
    got = got[np.lexsort(got.T[::-1])]  # the same rows in the same order at every run
    return fit(stats.ratios(got[:, 1:]), got[:, 0].astype(float), **how)


def score(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, one row per input row.

    A NULL text is an empty one and is scored too; a NULL id is not held out.
    """
    def run(batch):
        got = np.array([stats.measure(t) for t in texts(batch)], np.int64).reshape(-1, len(stats.COUNTS))
        p = model.scores(stats.ratios(got))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": (p >= threshold).astype(int)}

    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return map_texts(docs, ["doc_id", "text", held_out], run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text scores at least ``threshold``."""
    import pyarrow as pa

    from .common import text_slices

    def run(batches):
        for batch in text_slices(batches):
            got = np.array([stats.measure(t) for t in texts(batch)], np.int64).reshape(-1, len(stats.COUNTS))
            yield batch.filter(pa.array(model.scores(stats.ratios(got)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
