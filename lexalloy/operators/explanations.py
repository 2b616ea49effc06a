"""Explanations of predictions: exact attributions of tree ensembles and linear models, word importance by perturbed texts, and
both with the nearest labelled rows.

Models are small (their paths are broadcast); rows are attributed in Arrow batches, perturbed texts are made and
scored where the rows are, and one small regression a document is solved from its samples. Nothing loops over rows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import Scorer


@dataclass(frozen=True)
class Path:
    """What leads to a leaf: each feature on the way once, with the range (low, high] that leads on and the share of training rows,
    of those that reach its splits, that do lead on. value: what the leaf adds to the margin."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray


def tree_paths(model: object) -> list[Path]:
    """The paths of a fitted tree, forest or boosted ensemble of pyspark.ml; margins are the probability of class 1 for trees and
    forests of classifiers, and the sum of weighted predictions for all others."""
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0]))
    name = type(model).__name__
    classes = name.startswith(("DecisionTreeClassification", "RandomForestClassification"))
    scale = 1 / sum(weights) if name.startswith("RandomForest") else 1.0
    out: list[Path] = []

    def walk(node: object, weight: float, way: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            value = node.prediction()
            if classes:
                stats = list(node.impurityStats().stats())
                value = stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
            places = sorted(way)
            out.append(Path(weight * value, np.array(places, dtype=int), *(np.array([way[f][i] for f in places]) for i in range(3))))
            return
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("splits on categories have no attributions here")
        f, cut, total = split.featureIndex(), split.threshold(), node.impurityStats().count()
        low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
        for child, edges in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, way | {f: (*edges, share * child.impurityStats().count() / total)})

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree._java_obj.rootNode(), weight * scale, {})
    return out


def path_shares(inside: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1. inside: patterns x features of the path, whether a row's value leads on; a feature out of the
    coalition leads on with its share."""
    patterns, m = inside.shape
    out = np.zeros((patterns, m))
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    for f in range(m):
        poly = np.zeros((patterns, m))  # by the number of other features in the coalition
        poly[:, 0] = 1
        for j in range(m):
            if j != f:
                poly[:, 1:] = poly[:, 1:] * shares[j] + poly[:, :-1] * inside[:, j : j + 1]
                poly[:, 0] = poly[:, 0] * shares[j]
        out[:, f] = (inside[:, f] - shares[f]) * (poly @ weight)
    return out


def base_value(paths: list[Path]) -> float:
    return float(sum(p.value * p.shares.prod() for p in paths))


def path_attributions(x: np.ndarray, paths: list[Path]) -> np.ndarray:
    """Path-dependent Shapley values of each row and feature; with ``base_value`` they add up to the margin."""
    x = np.where(np.isnan(x), np.inf, x)  # as the trees do: what isn't at most a threshold goes right
    out = np.zeros(x.shape)
    for p in paths:
        if not len(p.features):
            continue
        own = x[:, p.features]
        inside = (own > p.low) & (own <= p.high)
        patterns, place = np.unique(np.packbits(inside, axis=1), axis=0, return_inverse=True)
        bits = np.unpackbits(patterns, axis=1, count=len(p.features)).astype(float)
        out[:, p.features] += p.value * path_shares(bits, p.shares)[place.ravel()]
    return out


def attributions(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows with ``values`` (a Shapley value a feature) and ``base``: together they add up to the model's margin. Tree models: exact
    and path-dependent. Linear ones: coefficient times distance from the mean of rows, margin the decision value."""
    features, model = scorer.config.features, scorer.model
    x = vector_to_array(F.col(features))
    if hasattr(model, "coefficients"):
        mean = rows.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"]
        coefficients, base = model.coefficients.toArray(), float(model.intercept)
        if mean is None:  # no rows
            return rows.withColumns({"values": F.lit(None).cast("array<double>"), "base": F.lit(None).cast("double")})
        mean = mean.toArray()
        base += float(coefficients @ mean)
        paths = None
    else:
        paths = tree_paths(model)
        base = base_value(paths)
    shared = rows.sparkSession.sparkContext.broadcast(paths if paths is not None else (coefficients, mean))

    @F.pandas_udf("array<double>")
    def explain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=object)
                continue
            at = np.stack(part.to_list())
            yield pd.Series(list(path_attributions(at, shared.value) if paths is not None else shared.value[0] * (at - shared.value[1])))

    return rows.withColumns({"values": explain(x), "base": F.lit(base)})


_PIECES = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}]+"
_WORD = r"^[\p{L}\p{M}\p{Nd}\p{Pc}]"


def ridge(masks: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and offset of a weighted ridge regression, by the smaller of its two systems."""
    total = weight.sum()
    middle, level = weight @ masks / total, float(weight @ y / total)
    root = np.sqrt(weight)
    a, b = (masks - middle) * root[:, None], (y - level) * root
    n, d = a.shape
    found = np.linalg.solve(a.T @ a + penalty * np.eye(d), a.T @ b) if d <= n else a.T @ np.linalg.solve(a @ a.T + penalty * np.eye(n), b)
    return found, level - float(middle @ found)


def perturbed(docs: DataFrame, id_col: str, text_col: str, samples: int, seed: int) -> DataFrame:
    """A row a document and sample: id, sample, words (distinct, sorted), mask (1: the word stays), text without the other words. Sample 0 is the whole text;
    each other one leaves a share of the words out that is even over samples, and chooses words by a hash of word, document, sample and seed."""
    words = F.array_sort(F.array_distinct(F.filter(F.col("_pieces"), lambda p: p.rlike(_WORD))))
    cut = docs.select(F.col(id_col), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_PIECES), F.lit(0)).alias("_pieces")).withColumn("words", words)
    each = cut.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    key = F.col(id_col).cast("string")
    share = F.when(F.col("sample") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(key, F.col("sample"), F.lit(seed)), F.lit(1 << 20)))
    stays = lambda w: F.pmod(F.xxhash64(w, key, F.col("sample"), F.lit(seed + 1)), F.lit(1 << 20)) >= F.col("_share")
    each = each.withColumn("_share", share)
    text = F.array_join(F.filter("_pieces", lambda p: ~p.rlike(_WORD) | stays(p)), "")
    return each.select(id_col, "sample", "words", F.transform("words", lambda w: stays(w).cast("tinyint")).alias("mask"), text.alias(text_col))


def word_importance(docs: DataFrame, score: Callable[[DataFrame], DataFrame], id_col: str = "id", text_col: str = "text", samples: int = 500, top: int = 10, width: float = 25.0, penalty: float = 1.0, seed: int = 7) -> DataFrame:
    """(id, place, word, weight, offset, probability): each document's ``top`` words by what they weigh in a local linear model.

    Samples leave words out, ``score`` (which adds probability to a table with the text column) judges them, samples count by their closeness to
    the whole text, and a ridge regression on all words chooses the heaviest, on which a second one is fitted.
    Ids must be unique; null and empty texts have no words and no rows. A document's group holds ``samples`` rows, whatever the table's size."""
    scored = score(perturbed(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, samples, seed)).select(F.col(id_col).alias("id"), "sample", F.when(F.col("sample") == 0, F.col("words")).alias("words"), "mask", F.col("probability").cast("double").alias("probability"))
    kind = docs.schema[id_col].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("sample")
        words = group.column("words")[0].as_py()  # sample 0 alone brings them
        ids, d = group.column("id"), len(words)
        if not d:
            return pa.table({"id": ids.slice(0, 0), "place": pa.array([], pa.int32()), "word": pa.array([], pa.string()), "weight": pa.array([], pa.float64()), "offset": pa.array([], pa.float64()), "probability": pa.array([], pa.float64())})
        masks = group.column("mask").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, d)
        y = group.column("probability").to_numpy()
        away = 100 * (1 - np.sqrt(masks.sum(axis=1) / d))
        weight = np.sqrt(np.exp(-((away / width) ** 2)))
        first, _ = ridge(masks, y, weight, penalty)
        chosen = np.lexsort((np.arange(d), -np.abs(first).round(12)))[:top]
        found, offset = ridge(masks[:, chosen], y, weight, penalty)
        order = np.lexsort((np.arange(len(chosen)), -np.abs(found).round(12)))
        k = len(order)
        return pa.table({"id": ids.slice(0, k) if k <= len(ids) else pa.chunked_array([pa.array([ids[0].as_py()] * k, ids.type)]), "place": pa.array(range(1, k + 1), pa.int32()), "word": [words[chosen[i]] for i in order], "weight": found[order], "offset": np.full(k, offset), "probability": np.full(k, y[0])})

    out = scored.groupBy("id").applyInArrow(solve, f"id {kind}, place int, word string, weight double, offset double, probability double")
    return out.withColumnRenamed("id", id_col)


def explained(importance: DataFrame, neighbours: DataFrame, threshold: float, id_col: str = "id", names: tuple[str, str] = ("negative", "positive")) -> DataFrame:
    """A row a document: its prediction, the probability of what is predicted, its words (by place) and its nearest labelled rows (by similarity).
    importance: of ``word_importance``; neighbours: query, neighbour, similarity and whatever else is to be shown of a neighbour."""
    words = importance.groupBy(id_col).agg(F.first("probability").alias("_p"), F.array_sort(F.collect_list(F.struct("place", "word", "weight"))).alias("words"))
    shown = [c for c in neighbours.columns if c not in ("query", "similarity")]
    near = neighbours.groupBy(F.col("query").alias(id_col)).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "similarity", *shown))).alias("neighbours"))
    positive = F.col("_p") >= threshold
    near = near.withColumn("neighbours", F.transform("neighbours", lambda n: n.dropFields("order")))
    out = words.join(near, id_col, "left")
    return out.select(id_col, F.when(positive, F.lit(names[1])).otherwise(F.lit(names[0])).alias("prediction"), F.when(positive, F.col("_p")).otherwise(1 - F.col("_p")).alias("probability"), "words", F.coalesce("neighbours", F.array()).alias("neighbours"))


def ranked(attributed: DataFrame, id_col: str, names: Column, top: int = 5) -> DataFrame:
    """(id, place, name, value): the features that move each row's margin most. names: an array of the features' names."""
    pairs = F.explode(F.arrays_zip(names.alias("name"), F.col("values").alias("value")))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.abs("value")), "name"))
    flat = attributed.select(id_col, pairs.alias("p")).select(id_col, F.col("p.name").alias("name"), F.col("p.value").alias("value"))
    return flat.withColumn("place", place).filter(F.col("place") <= top)
