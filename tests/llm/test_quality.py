import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexalloy.llm import boosting, decision_lists, text_stats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def odd_texts():
    r = random.Random(5)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\ty\x0bz w\u0085v", "é 😀😀 |<>#", "A a\nA a\n\nA a\r\nb"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "b", "cc", "é", "\n", "\t", "#"]) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randint(0, 150))))
    return out


def test_base_statistics_equal_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, score int")
    rows = text_stats.base_statistics(docs.drop("n_words", "score")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_features_are_never_null(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    for r in text_stats.with_features(docs).collect():
        assert all(r[c] is not None and np.isfinite(r[c]) for c in text_stats.FEATURES)


def test_trees_learn_a_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.6)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    one = np.array([model.predict(row[None])[0] for row in x[:50]])
    assert np.allclose(one, model.predict(x[:50]))


def test_trees_without_two_labels():
    assert np.allclose(boosting.fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((3, 2))), 0.5)
    assert (boosting.fit(np.ones((5, 2)), np.ones(5)).predict(np.zeros((3, 2))) > 0.9).all()


def test_decision_list_is_ordered_and_pruned():
    r = np.random.default_rng(2)
    x = r.random((2000, 2))
    y = (~((x[:, 0] > 0.75) & (x[:, 1] > 0.5))).astype(float)
    rules = decision_lists.learn(x, y, ("a", "b"))
    assert 1 <= len(rules.rules) <= 6 and rules.default
    kept = [not any(all((v[0] if c.feature == "a" else v[1]) > c.threshold if c.above else (v[0] if c.feature == "a" else v[1]) <= c.threshold for c in cs) for cs, _ in rules.rules) for v in x]
    assert (np.array(kept) == y).mean() > 0.95


def documents(spark, n=400):
    r = random.Random(7)
    good = lambda: " ".join(r.choice("abcdefghij") * r.randint(2, 9) + r.choice(["", "", ","]) for _ in range(120))
    rows = [(i, good() if i % 4 else " ".join(w + "***" for w in good().split()), i % 2) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(None, "z", None, None), (5, None, "x", "y")], "doc_id long, text string, score string, kept string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _, _ in rows if i % 3] + [(None, 1, 0), (7, None, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier_over_documents(spark):
    docs, labels = documents(spark)
    out = boosting.scored(docs, labels, F.lit(True)).collect()
    assert len(out) == docs.count()
    scores = [(r.doc_id, r.predicted) for r in out if r.doc_id is not None]
    assert np.mean([p == int(i % 4 != 0) for i, p in scores]) > 0.98
    assert boosting.scored(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {r.score for r in boosting.scored(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_rules_over_documents(spark):
    docs, labels = documents(spark)
    out, rules = decision_lists.judged(docs, labels)
    got = [(r.doc_id, r.kept) for r in out.collect()]
    assert len(got) == docs.count() and rules.rules
    assert np.mean([k == (i is not None and i % 4 != 0) for i, k in got]) > 0.98
    assert decision_lists.judged(docs.limit(0), labels)[0].count() == 0


def test_flattened_trees_equal_a_scalar_walk():
    r = np.random.default_rng(7)
    x = r.random((1500, 5))
    y = ((x[:, 0] + x[:, 3] > 1.1) | (x[:, 2] < 0.1)).astype(float)
    model = boosting.fit(x[:1000], y[:1000], trees=25)
    for row in x[1000:1200]:
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while model.left[t, node] != node:
                node = int(model.left[t, node] if row[model.feature[t, node]] <= model.threshold[t, node] else model.right[t, node])
            total += model.value[t, node]
        assert abs(1 / (1 + np.exp(-total)) - model.predict(row[None])[0]) < 1e-9
    held = model.predict(x[1000:]) > 0.5
    assert (held == y[1000:]).mean() > 0.95


def test_a_list_of_several_conjunctions_is_learned_in_order(spark):
    r = np.random.default_rng(9)
    x = np.round(r.random((6000, 3)), 4)
    bad = ((x[:, 0] > 0.7) & (x[:, 1] < 0.4)) | ((x[:, 2] > 0.8) & (x[:, 0] < 0.3))
    rules = decision_lists.learn(x[:4000], (~bad[:4000]).astype(float), ("n_words", "mean_word", "symbol_share"))
    assert len(rules.rules) >= 2 and max(len(c) for c, _ in rules.rules) >= 2 and rules.default is True
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x[4000:]], "n_words double, mean_word double, symbol_share double")
    got = np.array([v.k for v in rows.select(rules.expression().alias("k")).collect()])

    def plain(v):
        for conditions, verdict in rules.rules:
            if all((v[("n_words", "mean_word", "symbol_share").index(c.feature)] > c.threshold) == c.above for c in conditions):
                return verdict
        return rules.default

    assert got.tolist() == [plain(v) for v in x[4000:]]
    assert (got == ~bad[4000:]).mean() > 0.93


def test_a_repeated_labelled_id_gives_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(2, "d e f g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert boosting.training_rows(text_stats.with_features(docs), labels, "quality", F.lit(True), "doc_id", 10).count() == 2
    scored = boosting.scored(docs, labels, F.lit(True))
    assert scored.count() == 51 and boosting.scored(docs.limit(0), labels, F.lit(True)).count() == 0
