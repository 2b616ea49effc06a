import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexalloy.operators import blocks, features, latent, models


def made(spark, n=180, size=90, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        places = sorted(rng.choice(size, int(rng.integers(0, 12)), replace=False).tolist())
        rows.append((i, Vectors.sparse(size, places, (rng.random(len(places)) + 0.1).tolist()) if i % 7 else Vectors.dense(rng.random(size) * (rng.random(size) < 0.1)), i % 2))
    return spark.createDataFrame(rows, ["doc_id", "features", "label"]), np.array([r[1].toArray() for r in rows])


def test_singular_values_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(latent, "CHUNK", 500)
    rows, x = made(spark)
    found = latent.factorised(rows.repartition(5), 8, most=60)
    _, values, basis = np.linalg.svd(x)
    assert np.abs(found.values - values[:8]).max() < 1e-6 * values[0] and found.residual <= 1e-8
    assert np.abs(np.abs((basis[:8] @ found.basis).diagonal()) - 1).max() < 1e-6
    assert abs(found.explained(8) - (values[:8] ** 2).sum() / (x**2).sum()) < 1e-9
    got = np.array([r.latent for r in found.apply(rows).orderBy("doc_id").collect()])
    assert np.abs(got - x @ found.basis).max() < 1e-9
    fewer = latent.factorised(rows, 3)
    assert np.abs(fewer.basis - found.basis[:, :3]).max() < 1e-5  # prefixes serve smaller sizes


def test_odd_matrices(spark):
    rows = spark.createDataFrame([(1, Vectors.sparse(4, [], [])), (2, Vectors.dense([0.0] * 4))], ["doc_id", "features"])
    assert latent.factorised(rows, 2).values.tolist() == [0, 0]
    one = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0, 0.0])) for i in range(6)], ["doc_id", "features"])
    found = latent.factorised(one, 5)
    assert len(found.values) == 3 and np.abs(found.values - [np.sqrt(30), 0, 0]).max() < 1e-6
    assert latent.factorised(one.limit(0), 2).basis.shape[1] == 0


def test_sparse_end_to_end(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 8))) for i in range(60)], "id long, t string")
    weights = features.tf_idf(docs, "id", "t", pattern=r"\w+", min_df=2)
    vectors = features.vectors(weights, "id")
    assert type(vectors.first().features).__name__ == "SparseVector"
    stored = {(r.id, r.term): r.weight for r in weights.collect()}
    terms = sorted({t for _, t in stored})
    for r in vectors.collect():
        assert {terms[p]: v for p, v in zip(r.features.indices, r.features.values, strict=True)} == {t: w for (i, t), w in stored.items() if i == r.id}


def test_sizes_are_tuned_from_one_factorisation(spark):
    rng = np.random.default_rng(5)
    rows = [(i, Vectors.dense((rng.standard_normal(30) + 3 * (i % 2) * (np.arange(30) < 3)).tolist()), i % 2, float(i % 3)) for i in range(120)]
    frame = spark.createDataFrame(rows, ["doc_id", "features", "label", "beside"]).coalesce(1)
    found = latent.tuned(frame, (1, 2, 6), models.Config("logistic", (("maxIter", 5),)), fit_on=F.col("doc_id") < 90, folds=2, others=("beside",)).orderBy("components").collect()
    assert [r.components for r in found] == [1, 2, 6] and all(a.explained < b.explained for a, b in zip(found, found[1:], strict=False))
    assert all(0 <= r.f_beta <= 1 and r.f_beta_std >= 0 for r in found) and found[-1].roc_auc > 0.9


def test_block_sums(spark):
    rows = spark.range(40).repartition(6)

    def part(batches):
        total = np.zeros((9, 4), dtype=np.int64)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                total[i % 9, i % 4] += i
        yield total

    want = np.zeros((9, 4), dtype=np.int64)
    for i in range(40):
        want[i % 9, i % 4] += i
    assert (blocks.summed(rows, part, (9, 4), "int64", per_block=8) == want).all()
