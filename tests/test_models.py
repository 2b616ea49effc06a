import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.operators import evaluation as ev
from lexalloy.operators import features as fe


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_rules_count_and_weigh(spark):
    rules = [fe.Rule("ticker", (r"nasdaq:\s*\w+",), 2.0), fe.Rule("jargon", ("short interest", "filing", "dividend"), 1.5, least=2), fe.Rule("animal", ("zoo", "cat"), 1.0, brand="Puma"), fe.Rule("event", ("bowl",), -2.0)]
    frame = spark.createDataFrame([("NASDAQ: X filing dividend zoo",), ("Puma cat Bowl",), (None,)], "t string")
    got = [tuple(r) for r in frame.select(*[c.alias(k) for k, c in fe.rule_flags(F.col("t"), rules).items()]).collect()]
    assert got == [(1, 1, 0, 0, 2, 3.5), (0, 0, 1, 1, 1, -1.0), (0, 0, 0, 0, 0, 0.0)]


def test_vocabulary_and_proximity(spark):
    text = "Nike (shoe) a b shoe. c"
    counts = fe.vocabulary_counts(F.col("t"), {"wear": ["shoe", "bag"], "money": ["stock"]})
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in counts.items()]).first()
    assert (row.n_wear, row.has_wear, row.n_money, row.n_vocabulary) == (1, 1, 0, 1)
    assert tuple(one(spark, text, fe.proximity(F.col("t"), ["Nike"], ["shoe"], reach=2))) == (1.0, 1.0, 1, 1)
    assert tuple(one(spark, None, fe.proximity(F.col("t"), ["Nike"], ["shoe"]))) == (100.0, 100.0, 0, 0)
    assert tuple(one(spark, "Nike bad x good bad", fe.negative_context(F.col("t"), ["nike"], ["bad"], ["good"], 3))) == (2, 1, 0.5, 0)
    assert tuple(one(spark, "a k b k c", fe.keyword_clusters(F.col("t"), ["k"]))) == (40.0, 2, 2.0)
    assert one(spark, "puma", fe.multi_hot(F.col("t"), ["Nike", "Puma"])) == [0, 1]
    assert one(spark, "News.Example.com", fe.source_reputation(F.col("t"), [("example.com", 0.9), ("news", 0.1)])) == 0.9


def test_tf_idf_equals_hand_computation(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "green blue")], "id long, t string")
    got = {(r.id, r.term): r.weight for r in fe.tf_idf(docs, "id", "t", min_df=2, max_df=1.0).collect()}
    idf = np.log(4 / 3) + 1
    a, b = (1 + np.log(2)) * idf, idf
    assert got[1, "red"] == pytest.approx(a / np.hypot(a, b)) and got[2, "green"] == pytest.approx(b / np.hypot(b, b)) and (1, "red red") not in got


def scores(n=400):
    r = random.Random(2)
    return [(round(min(1.0, max(0.0, r.gauss(0.4 + 0.3 * (i % 3 == 0), 0.2))), 2), int(i % 3 == 0)) for i in range(n)]


def test_metrics_equal_brute_force(spark):
    rows = scores()
    m = ev.metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y", 0.5).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert m.tp == sum(s >= 0.5 for s in pos) and m.fp == sum(s >= 0.5 for s in neg)
    assert m.roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    steps, last = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, found = sum(s >= t for s in pos), sum(s >= t for s, _ in rows)
        steps, last = steps + (tp - last) / len(pos) * tp / found, tp
    assert m.average_precision == pytest.approx(steps)
    thresholds = {r.target: r.threshold for r in ev.recall_thresholds(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()}
    for target, t in thresholds.items():
        assert sum(s >= t for s in pos) >= target * len(pos) and sum(s > t for s in pos) < target * len(pos)


def test_drift(spark):
    r = random.Random(1)
    a, b = [r.uniform(0.3, 0.7) for _ in range(100)], [r.uniform(0.7, 0.95) for _ in range(50)]
    frame = lambda xs: spark.createDataFrame([(x, int(x > 0.5)) for x in xs], "v double, d int")
    far, same = ev.ks_drift(frame(a), frame(b), "v", "d").first(), ev.ks_drift(frame(a), frame(a), "v", "d").first()
    assert far.statistic == pytest.approx(1.0) and far.p_value < 1e-6 and far.drifted
    assert same.statistic == 0 and not same.drifted and same.p_value == 1.0
    assert not ev.ks_drift(frame(a).limit(0), frame(b), "v").first().drifted


def test_split_and_registry(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, y int")
    got = {(r.y, r.split): r["count"] for r in ev.stratified(rows, "y", "id").groupBy("y", "split").count().collect()}
    assert got == {(y, s): n for y in (0, 1) for s, n in enumerate((30, 10, 10))}
    with pytest.raises(ValueError):
        ev.stratified(rows, "y", "id", (0.5, 0.2))
    registry = spark.createDataFrame([("fp", [1, 9, 0]), ("fp", [1, 10, 0]), ("ep", [2, 0, 0])], "model string, v array<int>")
    assert {(r.model, tuple(r.v)) for r in ev.latest_version(registry, F.col("v")).collect()} == {("fp", (1, 10, 0)), ("ep", (2, 0, 0))}
    assert ev.promotion(0.9, None) == (True, True) and ev.promotion(0.9, 0.895) == (True, False)
