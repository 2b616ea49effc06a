from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexalloy.operators import explanations as ex
from lexalloy.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((250, 5)).round(2)
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5) | (x[:, 2] > 1)).astype(int)
    return spark.createDataFrame([(i, Vectors.dense(v), int(c)) for i, (v, c) in enumerate(zip(x.tolist(), y, strict=True))], ["doc_id", "features", "label"]).cache()


def expectation(path, x, known):
    """What a leaf adds when only the known features are looked at."""
    out = path.value
    for f, lo, hi, share in zip(path.features, path.low, path.high, path.shares, strict=True):
        out *= float(lo < x[f] <= hi) if f in known else share
    return out


def by_subsets(paths, x):
    """Shapley values by their definition."""
    n, value = len(x), {}
    for k in range(n + 1):
        for s in combinations(range(n), k):
            value[frozenset(s)] = sum(expectation(p, x, s) for p in paths)
    out = np.zeros(n)
    for f in range(n):
        for s, v in value.items():
            if f not in s:
                out[f] += factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (value[s | {f}] - v)
    return out, value[frozenset()]


@pytest.mark.parametrize(("estimator", "params"), [("forest", (("numTrees", 7), ("maxDepth", 4), ("seed", 3))), ("boosting", (("maxIter", 5), ("maxDepth", 3), ("seed", 3))), ("logistic", ())])
def test_attributions_add_up_and_follow_the_definition(data, estimator, params):
    scorer = models.fitted(data, models.Config(estimator, params, balanced=estimator != "boosting"))
    found = ex.attributions(data, scorer).orderBy("doc_id").collect()
    raw = scorer.model.transform(data).orderBy("doc_id").collect()
    margin = {"forest": lambda r: r.probability[1], "boosting": lambda r: r.rawPrediction[1], "logistic": lambda r: r.rawPrediction[1]}[estimator]
    for r, m in zip(found, raw, strict=True):
        assert abs(sum(r["values"]) + r["base"] - margin(m)) < 1e-9
    if estimator != "logistic":
        paths = ex.tree_paths(scorer.model)
        for r in found[:12]:
            want, base = by_subsets(paths, r.features.toArray())
            assert np.abs(np.array(r["values"]) - want).max() < 1e-9 and abs(base - r["base"]) < 1e-9
    groups = {g.name: g for g in models.group_importance(ex.attributions(data, scorer), {"used": (0, 3), "noise": (3, 5)}).collect()}
    assert groups["used"].importance > groups["noise"].importance and abs(groups["used"].share + groups["noise"].share - 1) < 1e-9
    top = ex.ranked(ex.attributions(data, scorer), "doc_id", F.array(*map(F.lit, "abcde")), 2)
    assert top.count() == 500 and top.filter("place = 1 and name in ('a', 'b', 'c')").count() > 200


def test_missing_values_go_right(data):
    scorer = models.fitted(data, models.Config("forest", (("numTrees", 3), ("seed", 3))))
    paths = ex.tree_paths(scorer.model)
    odd, far = np.array([[np.nan] * 5]), np.array([[1e9] * 5])
    assert np.allclose(ex.path_attributions(odd, paths), ex.path_attributions(far, paths))
    assert ex.attributions(data.limit(0), scorer).count() == 0


def score(rows):
    good = F.size(F.regexp_extract_all("text", F.lit(r"\bgood\b"), F.lit(0)))
    bad = F.size(F.regexp_extract_all("text", F.lit(r"\bbad\b"), F.lit(0)))
    return rows.withColumn("probability", 1 / (1 + F.exp(-(2.0 * good - 3.0 * bad))))


def test_word_importance_equals_numpy(spark):
    long_text = " ".join(f"w{i}" for i in range(150)) + " good bad"
    docs = spark.createDataFrame([(1, "a good day, no bad thing: good"), (2, long_text), (3, None), (4, ""), (5, "!!"), (6, "bad"), (None, "good")], "id long, text string")
    got = ex.word_importance(docs, score, samples=80, top=4).orderBy("id", "place").collect()
    by_doc = {i: [r for r in got if r.id == i] for i in (1, 2, 6)}
    assert {r.id for r in got} == {1, 2, 6} and len(by_doc[6]) == 1
    assert {by_doc[1][0].word, by_doc[1][1].word} == {"good", "bad"}
    assert next(r.weight for r in by_doc[1] if r.word == "good") > 0 > next(r.weight for r in by_doc[1] if r.word == "bad")
    assert {by_doc[2][0].word, by_doc[2][1].word} == {"good", "bad"}  # more words than samples
    for i in (1, 2):
        rows = score(ex.perturbed(docs.filter(F.col("id") == i), "id", "text", 80, 7)).orderBy("sample").collect()
        assert rows[0].text == docs.filter(F.col("id") == i).first().text and all(rows[0].mask)
        z, y = np.array([r.mask for r in rows], dtype=float), np.array([r.probability for r in rows])
        w = np.sqrt(np.exp(-((100 * (1 - np.sqrt(z.sum(axis=1) / z.shape[1])) / 25) ** 2)))
        words = rows[0].words

        def fit(columns, z=z, y=y, w=w):  # with a free offset as one more column
            a = np.c_[z[:, columns], np.ones(len(z))]
            return np.linalg.solve(a.T @ (a * w[:, None]) + np.diag([1.0] * len(columns) + [0.0]), a.T @ (w * y))

        every = fit(list(range(len(words))))[:-1]
        chosen = sorted(range(len(words)), key=lambda j: -abs(every[j]))[:4]
        want = dict(zip([words[j] for j in chosen], fit(chosen)[:-1], strict=True))
        assert {r.word for r in by_doc[i]} == set(want) and all(abs(r.weight - want[r.word]) < 1e-9 for r in by_doc[i])
    again = ex.word_importance(docs.repartition(3), score, samples=80, top=4).orderBy("id", "place").collect()
    assert again == got


def test_combined_explanation(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, "bad day")], "id long, text string")
    near = spark.createDataFrame([(1, 7, 0.9, "x"), (1, 8, 0.95, "y")], "query long, neighbour long, similarity double, label string")
    got = {r.id: r for r in ex.explained(ex.word_importance(docs, score, samples=40), near, 0.5).collect()}
    assert got[1].prediction == "positive" and [n.neighbour for n in got[1].neighbours] == [8, 7] and got[1].words[0].word == "good"
    assert got[2].prediction == "negative" and got[2].probability > 0.9 and got[2].neighbours == []


def test_words_travel_once_a_document(spark):
    """Samples bring masks; a document's words go to its group once, not once a sample."""
    seen = []
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "")], "id long, title string")
    out = ex.word_importance(docs, lambda rows: seen.append(rows) or rows.withColumn("probability", F.length("title") / 20), "id", "title", samples=8)
    assert "CASE WHEN (sample" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.word) for r in out.collect()} == {(1, "one"), (1, "two"), (1, "three"), (2, "four"), (2, "five")} and seen[0].count() == 24
