import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.llm import whitening as wh


@pytest.mark.parametrize(("d", "k", "decay"), [(40, 8, 0.0), (120, 8, 0.05), (30, 3, 0.3), (3, 8, 0.1), (12, 5, 2.0)])
def test_pairs_equal_numpy(d, k, decay):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((600, d)) * np.exp(-decay * np.arange(d))
    v = np.cov(x.T, bias=True)
    products = []

    def apply(b):
        products.append(b.shape[1])
        return v @ b

    values, vectors = wh.leading_pairs(apply, d, k, steps=4, most=24)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert max(products) <= 2 * (k + 4)  # blocks of vectors, never the matrix


def test_repeated_and_vanishing_eigenvalues():
    for spectrum in ([5, 5, 5, 5, 5, 1, 1, 1, 0.5, 0.5, 0, 0], [3] + [0] * 11, [0] * 12, [2] * 12):
        q = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))[0]
        v = (q * spectrum) @ q.T
        values, vectors = wh.leading_pairs(lambda b: v @ b, 12, 6)  # noqa: B023
        assert np.abs(values - np.array(spectrum[:6], dtype=float)).max() < 1e-13
        assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-13


def test_minres_solves_each_column():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    b[:, 1] = 0
    x = wh.minres(lambda v: a @ v, b, 60, 1e-14)
    assert np.abs(a @ x - b).max() < 1e-6 and not x[:, 1].any()


def brute(vectors, k=8):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    c = np.array([[n * v - s for v, s in zip(row, total, strict=True)] for row in x], dtype=float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return c @ q / np.sqrt(e), e / np.trace(c.T @ c / n), deviation


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK", 500)  # many blocks
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 20)) * np.exp(-0.1 * np.arange(20)) + 2).astype(np.float32).astype(float)
    vectors[7] = vectors[8]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 19 + [None]), (1003, [float("nan")] * 20), (1004, [float("-inf")] * 20), (1005, [1.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + odd, f"vec_id long, embedding array<{kind}>").withColumn("x", F.lit("clash")).repartition(3)
    rows = wh.whitened(df).toPandas()
    z, explained, deviation = brute(vectors.tolist())
    assert len(rows) == 300 * 8 and set(rows.vec_id) == set(range(300))
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < 1e-9
    first = rows[rows.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation and (rows.n == 300).all()
    assert np.abs(rows[rows.vec_id == 0].sort_values("component").explained.to_numpy() - explained).max() < 1e-12
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-12


def test_few_directions_null_ids_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.whitened(spark.createDataFrame([], schema)).count() == 0
    assert wh.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    line = wh.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], schema)).toPandas()
    assert line[line.component > 1].whitened.isna().all() and abs(line[line.component == 1].whitened.std(ddof=0) - 1) < 1e-12
    huge = wh.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0])], schema)).collect()
    assert {r["deviation"] for r in huge} == {None} and len(huge) == 4
