"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

``fit`` grows trees level by level on a bounded sample of labelled rows: features are cut into at most ``bins`` bins at
quantiles, each level's gradient histograms of all nodes and features come from one bincount. The trees are flattened
into arrays (feature, threshold, left, right, value), one row a tree, and ``predict`` walks all rows through a tree at a
time, vectorised. Scores are Platt-free sigmoids of the summed values.

``scored`` computes the statistics natively over every whole text (only numbers reach Python) and stores them, so that
texts are read once for fitting and scoring. Defined results: a null text counts as empty and is scored as such;
repeated rows are scored each; without labels of both kinds every score is the share of ones (0.5 without labels); null
labels and labels of unknown documents are ignored; an empty table gives an empty table; a very long text is counted
whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_stats
from .common import bounded_sample, stored


@dataclass(frozen=True)
class Trees:
    """All trees, flattened: node k of tree t is at [t, k]; a leaf points at itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, min_rows: int = 8, l2: float = 1.0) -> Trees:
    n, width = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    empty = Trees(base, *(np.zeros((0, size), t) for t in (np.int64, np.float64, np.int64, np.int64, np.float64)), depth)
    if not n or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    raw, grown = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(size, np.int64), np.full(size, np.inf)
        left, right, value = np.arange(size), np.arange(size), np.zeros(size)
        cut_bin, node = np.zeros(size, np.int64), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            inside = (node >= first) & (node < first + count)
            if not inside.any():
                break
            cell = ((node[inside] - first) * (width * bins))[:, None] + flat[inside]
            totals = [np.bincount(cell.ravel(), weights=np.repeat(w[inside], width), minlength=count * width * bins).reshape(count, width, bins).cumsum(axis=2) for w in (gradient, hessian, np.ones(n))]
            g, h, k = totals
            gs, hs, ks = (t[:, :, -1:] for t in totals)
            gain = g**2 / (h + l2) + (gs - g) ** 2 / (hs - h + l2) - gs**2 / (hs + l2)
            gain[(k < min_rows) | (ks - k < min_rows)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for i in range(count):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    at = first + i
                    feature[at], threshold[at], cut_bin[at] = f, cuts[f][b], b
                    left[at], right[at] = 2 * at + 1, 2 * at + 2
            node = np.where(inside, np.where(binned[np.arange(n), feature[node]] <= cut_bin[node], left[node], right[node]), node)
        sums = [np.bincount(node, weights=w, minlength=size) for w in (gradient, hessian)]
        value = rate * sums[0] / (sums[1] + l2)
        raw = raw + value[node]
        grown.append((feature, threshold, left, right, value))
    return Trees(base, *(np.stack(part) for part in zip(*grown, strict=True)), depth)


def training_rows(features: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, max_rows: int) -> DataFrame:
    """Labelled rows that may be learned from: their FEATURES and y. About max_rows at most, picked by hash of the id; an id that
    several rows have gives one row (the least), so that no repeated id exceeds the bound; an id with both labels gives a row a label."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter(learn).distinct()
    joined = features.join(bounded_sample(known, id_col, max_rows), id_col)
    return joined.groupBy(id_col, "y").agg(F.min(F.struct(*text_stats.FEATURES)).alias("row")).select("row.*", "y", F.xxhash64(F.col(id_col).cast("string"), F.lit(5)).alias("order"))


def fetched(rows: DataFrame) -> np.ndarray:
    """``training_rows`` on the driver (their number is bounded), in the order of a hash of the id: the same at every run."""
    found = sorted((r[-1], *r[:-1]) for r in rows.collect())
    return np.array([r[1:] for r in found], dtype=np.float64).reshape(-1, len(text_stats.FEATURES) + 1)


def scored(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """One row a document: id, the columns in keep, score, predicted. learn: says of a labels row whether it may be learned from."""
    features = stored(text_stats.with_features(docs.select(id_col, text_col, *keep), text_col), "features")
    rows = fetched(training_rows(features, labels, label_col, learn, id_col, max_rows))
    model = features.sparkSession.sparkContext.broadcast(fit(rows[:, :-1], rows[:, -1]))  # trees x nodes, whatever the corpus

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.value.predict(part.to_numpy(dtype=np.float64)))

    out = features.withColumn("score", score(F.struct(*[F.col(c).cast("double") for c in text_stats.FEATURES])))
    return out.select(id_col, *keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
