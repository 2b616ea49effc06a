"""Latent components of sparse rows (truncated SVD, rows not centred) by a randomised range finder with block Krylov passes, and the
choice of their number from one factorisation.

A pass is one Spark job over the rows as they are, sparse; what comes back is a vocabulary x block matrix. The driver holds the
subspace (vocabulary x a few hundred columns at most), never rows, never a vocabulary x vocabulary matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from . import models
from .blocks import summed

#: Numbers (entries x columns) that a task works on at once.
CHUNK = 1 << 22


def entries(vector: Column) -> tuple[Column, Column]:
    """The places and the values of a vector's stored entries, whether it is sparse or dense."""
    inner = F.unwrap_udt(vector)
    return F.coalesce(inner["indices"], F.sequence(F.lit(0), F.size(inner["values"]) - 1)), inner["values"]


def sparse_parts(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Places, values, row of each entry and the number of rows, of parts of a batch with columns of places and values."""
    sizes = batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    places, values = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK // max(columns, 1), side="right")) - 1)
        yield places[ends[at] : ends[to]].astype(np.int64), values[ends[at] : ends[to]].astype(float), np.repeat(np.arange(to - at), sizes[at:to]), to - at
        at = to


def projected(places: np.ndarray, values: np.ndarray, row: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The product of sparse rows and a basis."""
    out = np.zeros((n, basis.shape[1]))
    if len(places):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(basis[places] * values[:, None], first)
    return out


@dataclass(frozen=True)
class Latent:
    """Singular values, falling, right singular vectors (columns; the largest entry of each is positive), the residual they reached
    relative to the largest eigenvalue, and the sum of squares of all entries."""

    values: np.ndarray
    basis: np.ndarray
    residual: float
    total: float
    passes: int

    def explained(self, size: int) -> float:
        """The share of the rows' squares that the first components hold."""
        return float((self.values[:size] ** 2).sum() / self.total) if self.total else 0.0

    def apply(self, rows: DataFrame, features: str = "features", out: str = "latent") -> DataFrame:
        """rows with their components, an array."""
        shared = rows.sparkSession.sparkContext.broadcast(self.basis)

        @F.pandas_udf("array<double>")
        def project(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for places, values in parts:
                batch = pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["i", "v"])
                found = [row for p in sparse_parts(batch, shared.value.shape[1]) for row in projected(*p, shared.value)]
                yield pd.Series(found, dtype=object)

        return rows.withColumn(out, project(*entries(F.col(features))))


def factorised(rows: DataFrame, components: int, features: str = "features", extra: int = 10, tolerance: float = 1e-8, passes: int = 40, most: int = 400, seed: int = 0) -> Latent:
    """The first right singular vectors of the rows. Passes go on until the residuals of all components are below tolerance (relative
    to the largest eigenvalue), ``passes`` at most; the subspace is restarted beyond ``most`` columns. Null vectors count as empty."""
    data = stored(rows.select(*[c.alias(n) for c, n in zip(entries(F.col(features)), ("i", "v"), strict=True)]).filter("i IS NOT NULL"), "sparse_rows")
    size = rows.filter(F.col(features).isNotNull()).select(F.max(F.coalesce(F.unwrap_udt(features)["size"], F.size(F.unwrap_udt(features)["values"])))).first()[0] or 0
    total = data.select(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    k = min(components, size)
    wide = min(size, k + extra)
    if not k or not total:
        return Latent(np.zeros(k), np.eye(size, k), 0.0, total, 0)

    def gram(q: np.ndarray) -> np.ndarray:
        shared = data.sparkSession.sparkContext.broadcast(q)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            basis, out, seen = shared.value, None, False
            for batch in batches:
                for places, values, row, n in sparse_parts(batch, q.shape[1]):
                    if len(places):
                        out = np.zeros((size, basis.shape[1])) if out is None else out
                        y = projected(places, values, row, n, basis)
                        order = np.argsort(places, kind="stable")
                        first = np.flatnonzero(np.r_[True, np.diff(places[order]) != 0])
                        out[places[order][first]] += np.add.reduceat(y[row[order]] * values[order, None], first)
                        seen = True
            if seen:
                yield out

        found = summed(data, part, q.shape)
        shared.unpersist()
        return found

    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    basis = image = np.zeros((size, 0))
    for count in range(1, passes + 1):
        basis, image = np.c_[basis, new], np.c_[image, gram(new)]
        h = basis.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        left = image @ turn[:, :wide] - (basis @ turn[:, :wide]) * theta[:wide]
        residual = float(np.linalg.norm(left[:, :k], axis=0).max() / theta[0])
        if residual <= tolerance or basis.shape[1] >= size or count == passes:
            break
        if basis.shape[1] + wide > max(most, 2 * wide):  # the residuals go on where the passes before ended
            basis, image = basis @ turn[:, :wide], image @ turn[:, :wide]
        new = np.zeros((size, 0))
        for column in left.T:
            length = np.linalg.norm(column)
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
                column = column - new @ (new.T @ column)
            if np.linalg.norm(column) > max(1e-10 * length, 1e-14 * theta[0]):
                new = np.c_[new, column / np.linalg.norm(column)]
        if not new.shape[1]:
            break
    vectors = basis @ turn[:, :wide] if basis.shape[1] == len(turn) else basis[:, :wide]  # the latter: turned already
    at = 0
    while at < k:  # equal values: the same vectors whatever the start
        to = at + 1
        while to < vectors.shape[1] and theta[at] - theta[to] <= 1e-9 * theta[0]:
            to += 1
        vectors[:, at:to] = settled(vectors[:, at:to])
        at = to
    vectors = vectors[:, :k]
    sign = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    return Latent(np.sqrt(np.maximum(theta[:k], 0)), vectors * sign, residual, total, count)


def settled(basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what basis spans that depends on this space alone: each column in turn takes the whole of the
    first row that isn't short without the columns before it."""
    turn = np.eye(basis.shape[1])
    for i in range(basis.shape[1] - 1):
        rest = basis @ turn[:, i:]
        sizes = (rest**2).sum(axis=1)
        row = rest[np.argmax(sizes >= 0.01 * sizes.max())]
        axes = np.linalg.qr(np.c_[row, np.eye(len(row))])[0][:, : len(row)]
        turn[:, i:] = turn[:, i:] @ axes
    return basis @ turn


def swept(rows: DataFrame, found: Latent, sizes: Sequence[int], base: models.Config, folds: int = 3, id_col: str = "doc_id", others: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """A row a number of components: its share of squares, and mean and deviation of all measures over test folds. rows: with found's
    components in ``latent``, stored; the first ones serve each size. ``others`` are columns (numbers) that stand beside them."""
    beside = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in others]) if others else F.array().cast("array<double>")
    out = None
    for size in sizes:
        slim = rows.select(id_col, base.label, array_to_vector(F.concat(F.slice("latent", 1, size), beside)).alias(base.features))
        fits = models.searched(slim, base, {}, folds, id_col, seed).filter("part = 'test'")
        measures = [f(m).alias(f"{m}{n}") for m in (*models.MEASURES, "roc_auc") for n, f in (("", F.avg), ("_std", F.stddev_pop))]
        row = fits.agg(*measures).select(F.lit(size).alias("components"), F.lit(found.explained(size)).alias("explained"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def tuned(rows: DataFrame, sizes: Sequence[int], base: models.Config, fit_on: Column | None = None, folds: int = 3, id_col: str = "doc_id", others: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``swept`` over one factorisation (of the rows of fit_on) and one projection of all rows to the largest size."""
    found = factorised(rows if fit_on is None else rows.filter(fit_on), max(sizes), base.features, seed=seed)
    kept = stored(found.apply(rows, base.features).select(id_col, base.label, "latent", *others), "latent_rows")
    return swept(kept, found, sizes, base, folds, id_col, others, seed)
