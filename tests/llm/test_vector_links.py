import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.llm import vector_links as vl


def brute(ids, vectors, threshold):
    """All pairs, in double precision."""
    n = len(ids)
    good = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in vectors]
    u = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if g else None for v, g in zip(vectors, good, strict=True)]
    hit = np.array([[i != j and good[i] and good[j] and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= threshold for j in range(n)] for i in range(n)])
    label = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(hit[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    least = {c: min(ids[i] for i in range(n) if label[i] == c) for c in set(label)}
    return sorted((ids[i], int(hit[i].sum()), least[label[i]], ids[i] == least[label[i]]) for i in range(n))


def cloud(rng, n, d, groups):
    """Groups of near vectors of all sizes, chains at the edge of the threshold, exact copies, loose vectors."""
    centres = rng.standard_normal((groups, d))
    x = [centres[g] + rng.standard_normal(d) * rng.choice([0.02, 0.1, 0.25]) for g in rng.integers(0, groups, n)]
    x += [x[0]] * 7 + [3 * x[1]] + list(rng.standard_normal((n // 4, d)))
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    x += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.3)]  # each within reach of the next one only
    return np.array(x, dtype=np.float32)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force(spark, kind, monkeypatch):
    """Many small tiles and leaves, so that each level of the recursion is passed."""
    monkeypatch.setattr(vl, "LEAF", 5)
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in v] for v in cloud(rng, 240, 6, 12)]
    vectors += [None, [], [0.0] * 6, [float("nan")] + [1.0] * 5, [1.0] * 5 + [None], [float("inf")] * 6, [1.0, 2.0]]
    ids = [int(i) for i in rng.permutation(len(vectors)) - 20]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), f"vec_id long, embedding array<{kind}>").withColumn("seq", F.lit("clash"))
    got = sorted(tuple(r) for r in vl.grouped(df, threshold=0.95, dims=3, tile_bytes=20 * 24).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(ids, vectors, 0.95)


def test_blocks_are_skipped_and_counted_whole():
    """Distant blocks aren't multiplied, and a dense group isn't either."""
    rng = np.random.default_rng(5)
    groups = [vl.unit(c + 0.001 * rng.standard_normal((512, 16))) for c in rng.standard_normal((4, 16))]
    x = np.concatenate(groups)
    counts, forest, work = vl.joined_tiles(x, None, np.ones(len(x), dtype=np.int64), None, 0.95)
    assert (counts == 511).all() and len(forest) == len(x) - 4 and work == 0
    spread = vl.unit(rng.standard_normal((2000, 16)))
    counts, _, work = vl.joined_tiles(spread, None, np.ones(2000, dtype=np.int64), None, 0.95)
    want = (spread @ spread.T >= 0.95).sum(axis=1) - 1
    assert (counts == want).all()


def test_tiny_and_huge_entries_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert vl.grouped(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1e-200, 0.0]), (2, [1e200, 1e190]), (None, [5.0, 0.0]), (None, None), (4, [0.0, 1.0]), (4, [0.0, 1.0])]
    got = sorted((tuple(r) for r in vl.grouped(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, None), (None, 0, None, None), (4, 1, 4, True), (4, 1, 4, True)], key=repr)
    assert vl.grouped(spark.createDataFrame([(9, None)], schema)).collect()[0]["component_id"] == 9
