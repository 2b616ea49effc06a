import json
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexalloy.operators import evaluation, features, feed, matching, models
from lexalloy.sources import files, plugins


def test_running_sums_and_splits_equal_plain_ones(spark):
    r = random.Random(2)
    rows = sorted({round(r.random(), 3): r.randint(0, 5) for _ in range(500)}.items())
    df = spark.createDataFrame(rows, "v double, n long")
    for falling in (False, True):
        got = {x.v: (x.n_upto, x.n_all) for x in evaluation.running(df, "v", ("n",), falling, parts=7).collect()}
        total, want = 0, {}
        for v, n in (reversed(rows) if falling else rows):
            total += n
            want[v] = total
        assert got == {v: (t, total) for v, t in want.items()}
    assert evaluation.running(df.limit(0), "v", ("n",)).count() == 0
    labelled = spark.createDataFrame([(i, i % 3, "x") for i in range(3000)] + [(7, None, "y")], "id long, label int, _n string")
    split = evaluation.stratified(labelled, "label", "id")
    counts = {(x.label, x.split): x["count"] for x in split.groupBy("label", "split").count().collect()}
    assert split.columns == ["id", "label", "_n", "split"] and all(counts[k, s] == n for k in range(3) for s, n in ((0, 600), (1, 200), (2, 200)))


def test_nearest_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 6), (91, [1.0]), (92, None), (93, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)

    def similar(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    for most in (4_000, 10):
        got = {}
        for m in matching.nearest(df.filter("id % 3 = 0"), df, 4, "id", "v", max_queries=most).collect():
            got.setdefault(m["query"], {})[m.neighbour] = m.similarity
        for i, v in rows:
            if i % 3 == 0:
                want = sorted(((-round(similar(v, u), 9), j) for j, u in rows if j != i))[:4]
                assert sorted(round(-s, 9) for s, _ in want) == pytest.approx(sorted(round(s, 9) for s in got[i].values()), abs=1e-9)


def test_audit_rebrand_rechunk(spark):
    rows = [(1, "A cat", "nothing", ["puma", "nike"]), (2, "x", "wild cat here", ["puma"]), (3, "x", None, ["nike"]), (4, "x", "y" * 3000 + " cat", ["puma"])]
    articles = spark.createDataFrame(rows, "id long, title string, full_content string, brands_mentioned array<string>")
    rules = [feed.AuditRule("nike", "nothing", "n"), feed.AuditRule("puma", r"\bcat\b", "animal"), feed.AuditRule("puma", "wild", "w")]
    assert {(x.id, x.audit_brand, x.audit_reason) for x in feed.audited(articles, rules).collect()} == {(1, "nike", "n"), (2, "puma", "animal")}
    kept, gone = feed.rebranded(articles, F.when(F.col("id") == 1, F.array(F.lit("nike"), F.lit("puma"))).when(F.col("id") == 2, F.array(F.lit("nike"))).otherwise(F.array().cast("array<string>")))
    assert {x.id for x in kept.collect()} == {2} and {x.id for x in gone.collect()} == {3, 4}
    text = "\n\n".join(" ".join(f"p{p}w{i}" for i in range(120)) + "." for p in range(5))
    made, linked = feed.rechunked(spark.createDataFrame([(1, text)], "id long, full_content string"), spark.createDataFrame([(1, 1, "p3w4 p3w5 p3w6", "old", 0.1), (2, 1, "zzz qqq", "old", 0.2)], "id long, article_id long, excerpt string, chunk_id string, relevance_score double"))
    chunks = {c.chunk_id: c.chunk_text for c in made.collect()}
    found = {x.id: x for x in linked.collect()}
    assert len(chunks) > 2 and "p3w4 p3w5" in chunks[found[1].chunk_id] and found[1].relevance_score == 1.0 and (found[2].chunk_id, found[2].relevance_score) == (None, 0.2)


def test_feed_nests_and_is_written(spark, tmp_path):
    articles = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", None)], "id long, title string, published_at string")
    labels = spark.createDataFrame([(10, 1, "B", True, 1, False, 1), (11, 1, "A", True, None, True, -1)], "id long, article_id long, brand string, social boolean, social_sentiment int, digital_transformation boolean, digital_sentiment int")
    evidence = spark.createDataFrame([(100, 10, "social", "find me", 0.9, 7), (101, 11, "digital", "other", 0.2, None)], "id long, brand_label_id long, category string, excerpt string, relevance_score double, chunk_id long")
    chunks = spark.createDataFrame([(7, "please find me here")], "id long, chunk_text string")
    items = feed.feed_items(articles, labels, evidence, chunks, ("social", "digital_transformation"))
    got = {x.id: x for x in items.collect()}
    assert got[1].brands == ["A", "B"] and got[1].categories == ["digital_transformation", "social"] and len(got[1].labels) == 3 and got[2].labels == []
    b = next(x for x in got[1].labels if x.brand == "B")
    assert (b.category, b.sentiment, b.evidence[0].confidence, b.evidence[0].snippet) == ("social", "positive", "high", "please find me here")
    assert [x.id for x in feed.newest(articles, 2).collect()] == [2, 1]
    sets = feed.feed_sets(items).first()
    assert sets.brands == ["A", "B"] and [(x.name, x.n) for x in feed.feed_tops(items, "brands", 1).collect()] == [("A", 1)]
    files.write_feed(items, f"{tmp_path}/feed", {"total": F.count("*")}, [F.desc_nulls_last("published_at"), F.col("id")], 2)
    written = json.loads("".join(x.value for x in spark.read.text(f"{tmp_path}/feed").collect()))
    assert written["total"] == 3 and [x["id"] for x in written["items"]] == [2, 1] and written["items"][1]["labels"][0]["brand"] == "A"


def test_sources_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 10:00:00", 0.5, "fp"), ("2024-01-02 10:00:00", None, "fp")], "t string, probability double, classifier string").select(F.to_timestamp("t").alias("timestamp"), "probability", "classifier")
    files.append_predictions(log, f"{tmp_path}/log")
    files.append_predictions(log, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").filter("day = '2024-01-02'").count() == 2
    files.write_reference(log, f"{tmp_path}/reference")
    assert spark.read.parquet(f"{tmp_path}/reference").count() == 2
    files.write_xml(log.select("probability", "classifier"), f"{tmp_path}/xml")
    assert spark.read.option("rowTag", "entry").xml(f"{tmp_path}/xml").count() == 2
    assert files.read_json_lines(spark, f"{tmp_path}/log/*/*", files.PREDICTION).count() == 4


def test_plugins_retry_and_give_up(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise TimeoutError
        return [t.upper() for t in texts]

    assert plugins.Plugin("answer", flaky, wait=0.0).called(["a"]) == ["A"] and calls == [1, 1, 1]

    def broken(texts):
        raise TimeoutError

    assert plugins.Plugin("answer", broken, wait=0.0).called(["a", "b"]) == [None, None]
    docs = spark.createDataFrame([("Nike runs",), (None,)], "t string")
    found = plugins.Plugin("entities", lambda ts: [[{"label": "ORG", "start": 0, "end": 4, "text": t[:4]}] if t else [] for t in ts]).column(F.col("t"))
    near = plugins.entities_near(found, F.array(F.lit(6)), {"org": ("ORG",), "place": ("GPE",)})
    assert [tuple(x) for x in docs.select(*[c.alias(k) for k, c in near.items()]).collect()] == [(1, 0), (0, 0)]


def rows_of(spark, n=400):
    r = random.Random(5)
    made = []
    for i in range(n):
        y = int(r.random() < 0.3)
        made.append((i, float(y), Vectors.dense([y + r.gauss(0, 0.3), r.gauss(0, 1), r.gauss(0, 1)])))
    return spark.createDataFrame(made, ["doc_id", "label", "features"]).withColumn("label", F.col("label").cast("int"))


def test_models_are_fitted_searched_and_compared(spark):
    rows = rows_of(spark)
    for name, params in (("logistic", ()), ("svm", (("maxIter", 20),)), ("forest", (("numTrees", 5), ("seed", 1)))):
        scorer = models.fitted(rows, models.Config(name, params))
        found = models.measured(rows, scorer)
        assert found["roc_auc"] > 0.95 and found["f_beta"] > 0.85, name
        row = scorer.score(rows).first()
        assert 0 <= row.probability <= 1 and row.predicted in (0, 1) and scorer.info()["estimator"] == name
    fits = models.searched(rows, models.Config("logistic"), {"regParam": [0.0, 100.0]}, folds=2)
    assert fits.count() == 8
    table = models.summarised(fits)
    found = {x.run: x.mean_test for x in table.collect()}
    assert len(found) == 2 and models.best(table).first().mean_test == max(found.values())
    assert {x.name for x in models.compared(rows, {"a": models.Config("logistic"), "b": models.Config("forest", (("numTrees", 3), ("seed", 1)))}, folds=2).collect()} == {"a", "b"}
    gaps = models.with_gap(spark.createDataFrame([(0.95, 0.80), (0.9, 0.84), (0.9, 0.89)], "mean_train double, mean_test double"))
    assert [x.verdict for x in gaps.orderBy("mean_test").collect()] == ["severe", "moderate", "good"]
    assert {x.measure: x.warning for x in models.shifted({"f1": 0.9, "recall": 0.8}, {"f1": 0.8, "recall": 0.79}, spark).collect()} == {"f1": True, "recall": False}


def test_importance_of_groups(spark):
    values = spark.createDataFrame([([1.0, -1.0, 0.5],), ([3.0, -1.0, 0.5],)], "values array<double>")
    got = {x.name: (x.importance, x.rank) for x in models.group_importance(values, {"a": (0, 2), "b": (2, 3)}).collect()}
    assert got == {"a": (3.0, 1), "b": (0.5, 2)}
    rows = rows_of(spark, 200)
    scorer = models.fitted(rows, models.Config("logistic"))
    ranked = models.permutation_importance(rows, scorer, {"signal": (0, 1), "noise": (1, 3)}).collect()
    assert ranked[0].name == "signal" and ranked[0].importance > 0.2 > abs(ranked[1].importance)


def test_latent_vectors_and_blocks(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "up down left"), (4, "up down")], "id long, t string")
    weights = features.weighted_terms(docs, "id", F.split("t", " "), min_df=1)
    assert {round(x.n, 9) for x in weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {1.0}
    vectors = features.vectors(weights, "id")
    x = np.array([r.features.toArray() for r in vectors.orderBy("id").collect()])
    got = np.array([r.latent.toArray() for r in features.latent(vectors, 2).orderBy("id").collect()])
    _, _, v = np.linalg.svd(x)
    assert np.allclose(np.abs(got), np.abs(x @ v[:2].T), atol=1e-6)
    assert [t.term for t in models.top_terms(weights, "id", 1).filter("id = 1").collect()] == ["blue"]
    blocks, names = features.assembled_blocks(spark.createDataFrame([(1.0, 2.0, True), (3.0, None, True), (100.0, 0.0, False)], "a double, b double, fit boolean"), {"x": ("a",), "y": ("b",)}, F.col("fit"))
    first = blocks.collect()[0].features.toArray()
    assert names == {"x": ["a"], "y": ["b"]} and np.allclose(first, [-0.70710678, 0.70710678])


def test_feature_columns(spark):
    docs = spark.createDataFrame([("puma shoe cat cat", ["puma", "nike"], "The Times", ["Sport"]), (None, None, None, None)], "t string, b array<string>, s string, c array<string>")
    near = features.vocabulary_near(F.col("t"), ["puma"], {"animal": ("cat",), "sport": ("shoe",)}, 2)
    summary = features.brand_summary(F.col("b"), ("puma",))
    meta = features.metadata(F.col("s"), F.col("c"), {"press": ("times",)}, {"sport": ("sport",)})
    rows = docs.select(*[c.alias(k) for k, c in (near | summary | meta).items()], features.several_categories(F.col("t"), {"a": ("cat",), "b": ("shoe",)}).alias("two"), F.get(features.characters(F.col("t"), (3, 3)), F.lit(0)).alias("first")).collect()
    assert rows[0].asDict() == {"n_near_animal": 1, "n_near_sport": 1, "n_brands": 2, "n_problematic": 1, "any_problematic": 1, "from_press": 1, "topic_sport": 1, "n_categories": 1, "has_categories": 1, "two": 1, "first": "pum"}
    assert all(v in (0, None) for v in rows[1].asDict().values())


def test_registry_tables(spark, tmp_path):
    from lexalloy.operators import registry

    rows = rows_of(spark, 120)
    for name in ("logistic", "svm"):
        scorer = models.fitted(rows, models.Config(name, (("maxIter", 10),), 0.4))
        registry.save(scorer, f"{tmp_path}/{name}", spark)
        again = registry.load(f"{tmp_path}/{name}", spark)
        want, got = ([round(x.probability, 9) for x in s.score(rows).orderBy("doc_id").collect()] for s in (scorer, again))
        assert want == got and again.config.threshold == 0.4
    registry.tracked(spark, f"{tmp_path}/runs", "r", "fit", {"f1": 0.5, "recall": 1.0})
    registry.tracked(spark, f"{tmp_path}/runs", "r", "fit", {"f1": 0.75})
    assert registry.latest_measures(spark.read.parquet(f"{tmp_path}/runs")).first().measures == {"f1": 0.75, "recall": 1.0}
    prompts = spark.createDataFrame([("p", [1, 0, 0], "old"), ("p", [1, 2, 0], "new")], "model string, version array<int>, text string")
    assert registry.current_prompts(prompts).first().text == "new"
    drift = spark.createDataFrame([("a", 0.3, True), ("b", 0.01, False)], "classifier string, score double, drifted boolean")
    assert [(x.severity, x.message) for x in registry.alerts(drift).collect()] == [("critical", "a drifted: score 0.300")]
    words = spark.createDataFrame([(0.83, [("rise", 0.4), ("fall", -0.1)])], "p double, w array<struct<word:string,weight:double>>")
    assert words.select(registry.explanation(F.col("p"), F.col("w")).alias("x")).first().x == "0.83: +rise (0.40), -fall (0.10)"
    early, late = evaluation.halves(spark.range(100).withColumn("t", F.col("id")), "t")
    assert early.count() + late.count() == 100 and abs(early.count() - 50) <= 2
