import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexalloy.operators import document_vectors as dv


def corpus(seed=3, n=60):
    """Texts of six topics; each has a near copy (one word in ten is another one)."""
    r = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = [r.choice(topics[i % 6] if r.random() < 0.7 else common) for _ in range(80)]
        copy = [r.choice(common) if r.random() < 0.1 else w for w in words]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return rows


SETTINGS = dv.Settings(size=24, window=2, negatives=4)


@pytest.fixture(scope="module")
def model(spark):
    return dv.trained(spark.createDataFrame(corpus(), "id long, text string"), "id", settings=SETTINGS, epochs=4, shards=3)


def test_same_whatever_the_partitions(spark, model):
    again = dv.trained(spark.createDataFrame(random.Random(1).sample(corpus(), 120), "id long, text string").repartition(7), "id", settings=SETTINGS, epochs=4, shards=3)
    assert again.words == model.words and (again.inner == model.inner).all() and (again.outer == model.outer).all()
    assert np.abs(model.outer).max() > 0.01 and model.inner.shape == (len(model.words), 24)


@pytest.mark.parametrize("window", [2, 0])
def test_near_copies_are_nearest(spark, model, window):
    frame = spark.createDataFrame(corpus(), "id long, text string")
    if not window:
        model = dv.trained(frame, "id", settings=dv.Settings(size=24, window=0, negatives=4), epochs=4, shards=3)
    got = {r.id: np.array(r.vector) for r in model.vectors(frame).collect()}
    x = np.array([got[i] / np.linalg.norm(got[i]) for i in range(120)])
    c = x @ x.T - 2 * np.eye(120)
    assert np.mean(c.argmax(axis=1) == (np.arange(120) ^ 1)) >= 0.9
    topic = np.arange(120) // 2 % 6
    assert np.mean(topic[c.argmax(axis=1)] == topic) >= 0.95


def test_unseen_and_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "nothing known"), (4, "t0w1  t0w2\n t0w3 " * 3000), (5, "t1w1 t1w2"), (5, "t1w1 t1w2")]
    got = model.vectors(spark.createDataFrame(rows, "id long, text string")).orderBy("id").collect()
    assert all(not any(r.vector) for r in got[:3]) and all(np.isfinite(r.vector).all() and any(r.vector) for r in got[3:])
    assert got[4].vector == got[5].vector
    empty = dv.trained(spark.createDataFrame([], "id long, text string"), "id")
    assert not any(empty.vectors(spark.createDataFrame([(1, "a")], "id long, text string")).first().vector)


def test_gradient_of_a_step():
    """One step equals the derivative of the sampled loss, by differences."""
    rng = np.random.default_rng(2)
    model = dv.Paragraphs(tuple("abcdefgh"), rng.standard_normal((8, 5)), rng.standard_normal((8, 5)), np.cumsum(np.full(8, 1 / 8))[:-1], dv.Settings(size=5, window=0, negatives=3, rate=1e-6))
    words = np.array([1, 4, 6, 2])
    moved = model.fitted(words, 9, 1, model.inner, model.outer, False) - model.start()
    draws = np.searchsorted(model.drawn, np.random.default_rng([42, 9, 0]).random((4, 3)), side="right")

    def loss(v):
        p = lambda z: np.log(1 / (1 + np.exp(-z)))
        return sum(p(model.outer[w] @ v) + sum(p(-model.outer[d] @ v) for d in ds if d != w) for w, ds in zip(words, draws, strict=True))

    want = [(loss(model.start() + h) - loss(model.start() - h)) / 2e-5 for h in np.eye(5) * 1e-5]
    assert np.abs(moved / 1e-6 - want).max() < 1e-4


def walked(model, words, key, passes, inner, outer, learn):
    """A text's steps one after the other, word by word within a step."""
    s, vector, rng, n = model.settings, model.start(), np.random.default_rng([model.settings.seed, key, 0]), len(words)
    for turn in range(passes):
        rate = s.rate * (1 - turn / (passes + 1))
        for at in range(0, n, dv.STEP):
            draws = np.searchsorted(model.drawn, rng.random((min(dv.STEP, n - at), s.negatives)), side="right")
            moved, moved_inner, moved_outer = np.zeros(s.size), np.zeros(inner.shape), np.zeros(outer.shape)
            for i, own in zip(range(at, n), draws, strict=False):
                around = [words[j] for j in range(max(0, i - s.window), min(n, i + s.window + 1)) if j != i]
                hidden = (vector + sum((inner[w] for w in around), np.zeros(s.size))) / (1 + len(around))
                for k, w in enumerate([words[i], *own]):
                    if k and w == words[i]:
                        continue
                    gap = (k == 0) - 1 / (1 + np.exp(-outer[w] @ hidden))
                    moved += gap * outer[w] * rate
                    moved_outer[w] += gap * hidden * rate
                    for c in around:
                        moved_inner[c] += gap * outer[w] * rate
            vector = vector + moved
            if learn:
                inner += moved_inner
                outer += moved_outer
    return vector


@pytest.mark.parametrize("window", [2, 0])
def test_texts_take_steps_together_and_each_as_if_alone(window, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(dv, "CHUNK", 64)
    model = dv.Paragraphs(tuple("abcdefgh"), rng.standard_normal((8, 5)), rng.standard_normal((8, 5)), np.cumsum(np.full(8, 1 / 8))[:-1], dv.Settings(size=5, window=window, negatives=3))
    sizes = np.array([0, 1, 33, 150, 32, 64, 0, 7] + [40] * 60)
    words, keys, ends = rng.integers(0, 8, sizes.sum()), np.arange(len(sizes)), np.cumsum(sizes)
    steps, gap = [], dv._gap
    monkeypatch.setattr(dv, "_gap", lambda *a: steps.append(1) or gap(*a))
    got = model.inferred(words, sizes, keys, 2, model.inner, model.outer)
    assert len(steps) <= 2 * 5  # those of the longest text, not the sum of all texts'
    for i in range(9):
        own = words[ends[i] - sizes[i] : ends[i]]
        assert np.allclose(got[i], walked(model, own, i, 2, model.inner, model.outer, False) if len(own) else 0, atol=1e-12)
        mine, plain = [(model.inner.copy(), model.outer.copy()) for _ in range(2)]
        assert np.allclose(model.fitted(own, i, 2, *mine, True), walked(model, own, i, 2, *plain, True), atol=1e-12)
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(mine, plain, strict=True))


def test_learning_prepares_many_texts_at_once_and_each_as_if_alone(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(dv, "CHUNK", 64)
    model = dv.Paragraphs(tuple("abcdefgh"), rng.standard_normal((8, 5)), rng.standard_normal((8, 5)), np.cumsum(np.full(8, 1 / 8))[:-1], dv.Settings(size=5, window=2, negatives=3))
    sizes = np.array([0, 1, 3, 150, 64, 65, 0, 7] + [4] * 60)
    words, keys, ends = rng.integers(0, 8, sizes.sum()), np.arange(len(sizes)) * 7, np.cumsum(sizes)
    asked, around = [], dv.Paragraphs._around
    monkeypatch.setattr(dv.Paragraphs, "_around", lambda *a: asked.append(1) or around(*a))
    own, alone = [(model.inner.copy(), model.outer.copy()) for _ in range(2)]
    got = model.learned(words, sizes, keys, 2, *own)
    assert len(asked) < len(sizes)
    for i, end in enumerate(ends):
        assert np.array_equal(got[i], model.fitted(words[end - sizes[i] : end], int(keys[i]), 2, *alone, True))
    assert all(np.array_equal(a, b) for a, b in zip(own, alone, strict=True))
    asked.clear()
    model.inferred(words[:40], np.array([40]), np.array([1]), 4, model.inner, model.outer)
    assert len(asked) == 1  # once, not once a pass


def test_matrices_of_a_broadcast_are_added_to_as_fast_as_others():
    """numpy compares types by identity there, and a pickled array brings its own."""
    sent = pickle.loads(pickle.dumps(np.ones((3, 2))))
    assert sent.copy().dtype is not np.dtype(float) and dv._own(sent).dtype is np.dtype(float) and (dv._own(sent) == sent).all()


def test_draws_and_words_are_those_of_a_search_and_a_split(spark):
    rng = np.random.default_rng(1)
    weight = np.r_[rng.random(3_000) ** 8, 1e-9, 1e-9, 5.0]
    drawn = np.cumsum(weight / weight.sum())[:-1]
    model = dv.Paragraphs((), np.zeros((0, 2)), np.zeros((0, 2)), drawn, dv.Settings())
    draws = np.r_[rng.random(50_000), drawn[drawn < 1], np.arange(65_536) / 65_536, 0.0, np.nextafter(1, 0)].reshape(-1, 1)
    assert np.array_equal(model._words_at(draws), np.searchsorted(drawn, draws, side="right"))
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "é", "b ", " ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x85", "\xa0", " ", "😀"]) for _ in range(r.randint(0, 20))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.filter(F.split(F.coalesce("t", F.lit("")), r"\s+"), lambda w: w != "").alias("w")).collect()
    assert [[w for w in found if w] for found in dv.tokens(pa.array(texts)).to_pylist()] == [r.w for r in rows]
