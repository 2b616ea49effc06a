import random

import pytest
from pyspark.sql import functions as F

from lexalloy.functions import text as tx
from lexalloy.operators import feature_store, models, training
from lexalloy.operators.models import Config


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        y = i % 2
        words = [r.choice(["rise", "gain", "up"] if y and r.random() < 0.5 else ["fall", "loss", "down"] if r.random() < 0.4 else ["the", "of", "and", "firm"]) for _ in range(20)]
        rows.append((i, " ".join(words) + f" only{i}", y, float(len(words) + y)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, size double").coalesce(1).cache()


FAST = Config("logistic", (("maxIter", 8),))


def test_features_learn_from_the_training_part_alone(docs):
    """A term that only the test fold has never weighs, and its rows change nothing that is learned."""
    part, rest = docs.filter("doc_id < 100"), docs.filter("doc_id >= 100").withColumn("text", F.concat("text", F.lit(" leak leak leak")))
    method = training.Method(min_df=1.0, max_df=1.0)
    alone = training.learned(part, method)
    vocabulary = alone.terms.stages[-3].vocabulary
    assert "leak" not in vocabulary and "only5" in vocabulary and "only120" not in vocabulary
    seen = alone.apply(rest).first().features
    assert seen.size == len(vocabulary) and seen.numNonzeros() < 12


def test_methods_by_classifiers_on_the_same_folds(docs):
    methods = {"terms": training.Method(min_df=2.0), "latent": training.Method(components=4, numbers=("size",))}
    fits = training.crossed(docs, methods, {"a": FAST}, folds=2)
    assert fits.count() == 8 and fits.filter("roc_auc > 0.9 and part = 'test'").count() >= 3
    best = training.chosen(fits).collect()
    assert len(best) == 2 and best[0]["mean"] >= best[1]["mean"]


def test_one_call_ends_in_a_saved_scorer(docs, tmp_path):
    method = training.Method(components=5, min_df=2.0, numbers=("size",))
    made = training.trained(docs.withColumn("label", F.when(F.col("doc_id") != 7, F.col("label"))), method, FAST, str(tmp_path / "m"), target_recall=0.9)
    assert sum(made.sidecar["rows"].values()) == 149 and abs(made.sidecar["rows"]["train"] - 90) <= 1
    assert made.sidecar["validation"]["recall"] >= 0.9 and made.sidecar["test"]["roc_auc"] > 0.8
    again = training.loaded(str(tmp_path / "m"))
    assert again.sidecar == made.sidecar and again.scorer.config.threshold == made.sidecar["threshold"]
    a, b = ({r.doc_id: r.probability for r in m.score(docs).collect()} for m in (made, again))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    assert made.score(docs.limit(0)).count() == 0


def test_only_new_texts_are_computed(spark, tmp_path):
    store, asked = feature_store.FeatureStore(spark, str(tmp_path)), []

    def compute(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.withColumn("n", F.length("text"))

    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id long, text string")
    first, count = store.features(docs, {"kind": "length", "v": 1}, compute)
    assert count == 3 and asked == [["", "a", "bb"]] and {r.id: r.n for r in first.collect()} == {1: 1, 2: 2, 3: 2, 4: 0, 5: 0}
    again, count = store.features(docs.withColumn("n", F.lit("clash")), {"v": 1, "kind": "length"}, compute)
    assert count == 0 and len(asked) == 1 and {r.id: r.n for r in again.collect()} == {1: 1, 2: 2, 3: 2, 4: 0, 5: 0}
    assert store.features(docs.union(spark.createDataFrame([(6, "ccc")], docs.schema)), {"kind": "length", "v": 1}, compute)[1] == 1
    with pytest.raises(Exception, match="division|DIVIDE"):  # a run that fails leaves what was there
        store.features(spark.createDataFrame([(9, "new")], docs.schema), {"kind": "length", "v": 1}, lambda r: r.withColumn("n", F.expr("CAST(1 / (length(text) - 3) AS INT)")))
    assert store.counts({"kind": "length", "v": 1}) == 4
    assert store.features(docs, {"kind": "length", "v": 2}, compute)[1] == 3  # another configuration: everything
    assert {c["v"] for c in store.configs()} == {1, 2}
    store.forget({"kind": "length", "v": 1})
    assert store.counts({"kind": "length", "v": 1}) == 0 and store.counts({"kind": "length", "v": 2}) == 3


def plain_windows(text, phrases, reach):
    out = []
    for p in phrases:
        pieces = text.lower().split(p)
        for i in range(1, len(pieces)):
            out += [*p.join(pieces[:i]).split()[-reach:], p, *p.join(pieces[i:]).split()[:reach]]
    return " ".join(out)


def test_windows_around_many_mentions(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["nike", "xnike", "nikenike", "a", "bb", "c"]) for _ in range(n)) for n in (0, 3, 40, 120)] + ["nike" * 30, "a " + "nike" * 12 + " b " + "nike" * 9 + "c d e f", "word " * 4000 + "nike"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.w for x in frame.select("i", tx.windows_around(F.col("t"), ["nike", "bb"], 3).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_windows(t, ["nike", "bb"], 3), i


def test_grid_rows_are_stored_once(docs):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["size"], outputCol="features").transform(docs)
    fits = models.searched(rows, FAST, {}, folds=2)
    assert fits.count() == 4
