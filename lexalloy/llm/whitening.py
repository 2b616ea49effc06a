"""Whitening of embeddings by their leading principal components: a block Jacobi-Davidson method over distributed products.

The covariance is never formed. Vectors become integers, are packed once into blocks of a few MB, and each product of the
centred data with a few vectors is one Spark job, whose tasks return d x b sums. The driver holds the search subspace only
(d x a few columns): Rayleigh-Ritz in the subspace, corrections from the projected equations by MINRES (all unfinished
pairs at once, a product a step), locking in order of the eigenvalues, thick restarts. The work ends when every residual
is as small as rounding leaves it.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those of
another length than the commonest (of equally common ones the longest). Entries beyond 2**42 are cut off there, so that integers stay
exact in double precision. Repeated rows and null ids are rows like others; no rows give no rows. A component without
variance (fewer than 8 independent directions) has whitened null and explained 0 and takes no part in identity_error;
vectors of fewer than 8 entries have as many components as entries. A deviation beyond the range of long is null.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries of a block: 2 MB as int32.
BLOCK = 1 << 19

#: x = floor(SCALE * c) + SHIFT; SHIFT cancels out of all that is returned.
SCALE, SHIFT = 1024.0, 100_000


def usable(vector: Column) -> Column:
    """True where a vector isn't null or empty and all its entries are finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, of equally common ones the longest; 0 without rows."""
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most"))
    most = lengths.first()[0]
    return most["d"] if most else 0


def dense(lists: pa.Array, d: int) -> np.ndarray:
    """Arrow lists of d numbers each, as a matrix of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def summed(blocks: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what part makes of each task's batches; only the sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.ravel(part(batches))], pa.list_(pa.float64()))})

    rows = blocks.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for i, v in rows:
        out[i] = v
    return out


def unpacked(data: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * d else np.int64).reshape(n, d)


def packed(rows: DataFrame, id_col: str, vector_col: str, d: int) -> DataFrame:
    """Blocks of vectors: ids, n, x (integers, row after row), hi and lo (sums of x >> 20 and of x & 0xFFFFF, which are exact)."""
    size = max(1, BLOCK // d)
    kind = rows.schema[id_col].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.floor(np.clip(dense(part.column(1), d), -(2.0**42), 2.0**42) * SCALE).astype(np.int64) + SHIFT
                data = (x if np.abs(x).max() >= 1 << 31 else x.astype(np.int32)).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                one = lambda v: pa.array([v.sum(axis=0).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), pa.array([data], pa.binary()), one(x >> 20), one(x & 0xFFFFF)], names=["ids", "n", "x", "hi", "lo"])

    return rows.select(id_col, vector_col).mapInArrow(pack, f"ids array<{kind.simpleString()}>, n int, x binary, hi array<long>, lo array<long>")


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column: all take a step at the same time, with one call of apply.
    Columns whose residual has fallen to ``enough`` times the first stand still."""
    beta = np.linalg.norm(right, axis=0)
    first = np.where(beta > 0, beta, 1)
    x, v_old, w_old, w = (np.zeros_like(right) for _ in range(4))
    v, eta, left = right / first, beta.copy(), beta.copy()
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)  # the off-diagonal entry before
    for _ in range(steps):
        live = left > enough * first
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - last * v_old
        off = np.linalg.norm(p, axis=0)
        hat = c * alpha - c_old * s * last
        rho = np.hypot(hat, off)
        live &= rho > 0
        safe = np.where(rho > 0, rho, 1)
        w_new = (v - (s_old * last) * w_old - (s * alpha + c_old * c * last) * w) / safe
        c_old, c, s_old, s = c, hat / safe, s, off / safe
        x += np.where(live, c * eta, 0) * w_new
        eta, left = -s * eta, np.where(live, left * np.abs(s), 0)
        w_old, w, v_old, v, last = w, w_new, v, p / np.where(off > 0, off, 1), off
    return x


def orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that span what new adds to against; columns that add nothing but rounding go."""
    for _ in range(2):
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
        new = new - against @ (against.T @ new)
    out: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            for o in out:
                column = column - o * (o @ column)
            column = column - against @ (against.T @ column)
        rest = np.linalg.norm(column)
        if rest > 1e-8 * max(size, 1e-300) and rest > 1e-10:
            out.append(column / rest)
    return np.array(out).T if out else np.zeros((len(against), 0))


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, steps: int = 5, guard: int = 4, most: int | None = None, tolerance: float | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of the positive semi-definite operator apply
    (d x b to d x b), by Jacobi-Davidson. ``most`` bounds the subspace, ``steps`` those of MINRES in a correction."""
    k = min(k, d)
    wide = min(d, k + guard)
    most = max(most or 4 * wide, 2 * wide)
    tolerance = tolerance or 4 * np.finfo(float).eps * np.sqrt(d)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, wide)))[0]
    image = apply(basis)
    locked, locked_image = np.zeros((d, 0)), np.zeros((d, 0))
    best, stalled = np.inf, 0
    while True:
        h = basis.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        want = k - locked.shape[1]
        if want == 0:  # nothing that is left in the subspace may be larger than what is locked
            values = (locked * locked_image).sum(axis=0)
            if not len(theta) or theta[0] <= values.min() * (1 + 1e-12):
                break
            worst = int(values.argmin())
            basis, image = np.c_[basis, locked[:, worst]], np.c_[image, locked_image[:, worst]]
            locked, locked_image = np.delete(locked, worst, axis=1), np.delete(locked_image, worst, axis=1)
            continue
        scale = max(theta[0], (locked * locked_image).sum(axis=0).max(initial=0), 0)
        many = min(basis.shape[1], want + guard)  # some more pairs than wanted: a product costs a job, not a column
        residual = image[:, :many] - basis[:, :many] * theta[:many]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual[:, :want], axis=0)
        stalled = 0 if norms[0] < best / 2 else stalled + 1
        best = min(best, norms[0])
        whole = basis.shape[1] + locked.shape[1] >= d  # the subspace is the space: what is left is rounding
        near = norms <= (1e-10 if stalled >= 3 else tolerance) * scale
        count = want if whole else int(np.argmin(near)) if not near.all() else want
        if count:
            locked, locked_image = np.c_[locked, basis[:, :count]], np.c_[locked_image, image[:, :count]]
            basis, image = basis[:, count:], image[:, count:]
            best, stalled = np.inf, 0
            if not basis.shape[1]:
                fresh = orthonormal(rng.standard_normal((d, wide)), locked)
                if not fresh.shape[1]:
                    break
                basis, image = fresh, apply(fresh)
            continue
        if basis.shape[1] + many > most:
            basis, image = basis[:, :wide], image[:, :wide]
        fixed = np.c_[locked, basis[:, :many]]
        project = lambda v: v - fixed @ (fixed.T @ v)  # noqa: B023, E731
        shifts = theta[:many]
        correction = minres(lambda v: project(apply(project(v)) - shifts * v), -project(residual), steps, 1e-3)  # noqa: B023
        fresh = orthonormal(correction, np.c_[locked, basis])
        if not fresh.shape[1]:
            fresh = orthonormal(rng.standard_normal((d, want)), np.c_[locked, basis])
        basis, image = np.c_[basis, fresh], np.c_[image, apply(fresh)]
    vectors = np.linalg.qr(locked)[0]
    h = vectors.T @ apply(vectors)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], vectors @ turn[:, ::-1]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """A row a vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    given = rows.select(F.col(id_col), F.col(vector_col)).filter(usable(F.col(vector_col)))
    d = common_length(given, vector_col)
    if not d:
        return spark.createDataFrame([], schema)
    blocks = stored(packed(given.filter(F.size(vector_col) == d), id_col, vector_col, d), "vectors")
    n = blocks.agg(F.sum("n")).first()[0]
    sums = blocks.select(F.posexplode(F.arrays_zip("hi", "lo")).alias("i", "s")).groupBy("i").agg(F.sum("s.hi").alias("hi"), F.sum("s.lo").alias("lo")).collect()
    total = [0] * d
    for i, hi, lo in sums:
        total[i] = (hi << 20) + lo
    mean = np.array([s / n for s in total])  # of whole numbers: rounded once
    data = blocks.select("x", "n").persist(StorageLevel.MEMORY_AND_DISK)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for x, m in zip(batch.column(0), batch.column(1), strict=True):
                yield unpacked(x.as_py(), d, m.as_py()) - mean

    def product(v: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((d, v.shape[1]))
            for c in centred(batches):
                out += c.T @ (c @ v)
            return out

        return summed(data, part).reshape(d, -1) / n

    try:
        trace = summed(data, lambda batches: np.array([sum((c * c).sum() for c in centred(batches))]))[0] / n
        values, vectors = leading_pairs(product, d, k)
        live = values > 1e-12 * max(trace, np.finfo(float).tiny)
        scaled = vectors[:, live] / np.sqrt(values[live])
        r = scaled.shape[1]
        offset = summed(data, lambda batches: sum(((c @ scaled).sum(axis=0) for c in centred(batches)), np.zeros(r))) / n if r else np.zeros(0)

        def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((r, r))
            for c in centred(batches):
                z = c @ scaled - offset
                out += z.T @ z
            return out

        error = float(np.abs(summed(data, spread).reshape(r, r) / n - np.eye(r)).max()) if r else 0.0
    finally:
        data.unpersist()
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, live, strict=True)]
    at, rank = np.flatnonzero(live), len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, ids = batch.column("n")[i].as_py(), batch.column("ids").slice(i, 1).flatten()
                x = unpacked(batch.column("x")[i].as_py(), d, m)
                z = np.full((m, rank), np.nan)
                z[:, at] = (x - mean) @ scaled
                off = deviations(x, n, total)
                take = np.repeat(np.arange(m), rank)
                flat = z.ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), m)), pa.array(np.full(m * rank, n, dtype=np.int64)), pa.array([off[j] for j in take], pa.int64()), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, m)), pa.array(np.full(m * rank, error))], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "n", "x").mapInArrow(score, schema)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)**2 over a row; None beyond long."""
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    worst = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, total, strict=True)]
    if sum(w * w for w in worst) < 1 << 63 and all(abs(n * v) < 1 << 63 and abs(s) < 1 << 63 for a, b, s in zip(low, high, total, strict=True) for v in (a, b)):
        off = x.astype(np.int64) * n - np.array(total, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
    return [w if w < 1 << 63 else None for w in whole]
