import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.llm import language_id

SYLLABLES = {"xa": ["tha", "ing", "ere", "ou"], "xb": ["ßen", "ück", "cht", "ver"], "xc": ["ción", "ado", "ñe", "los"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, 60), lang) for i, lang in enumerate(sorted(SYLLABLES) * 30)] + [(1000, None, "xa"), (1001, "zzz", None), (None, "q", "xa")]
    return language_id.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_single_languages_and_odd_texts(spark, model):
    r = random.Random(2)
    rows = [(i, text(r, lang, 5 + 30 * (i % 2)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    rows += [(100, None, "und"), (101, "", "und"), (102, "123 !!", "und"), (103, "a", None), (104, text(r, "xb", 400_00), "xb"), (107, "tha ere", "xa"), (107, "tha ere", "xa")]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang in rows}
    assert all(x.lang_pred == want[x.doc_id] for x in got if want[x.doc_id])
    assert all(0 <= x.score <= 1 and len(x.langs) == len(x.proportions) for x in got)
    assert next(x for x in got if x.doc_id == 103).lang_pred in SYLLABLES


def test_mixture_proportions_and_selected_set(model):
    r = random.Random(3)
    mixed = text(r, "xa", 300) + " " + text(r, "xc", 100)
    lang, share, langs, parts = model.infer([mixed, text(r, "xb", 200)], 3.0, 12)[0]
    assert lang == "xa" and langs == ["xa", "xc"] and abs(share - 0.75) < 0.1 and abs(sum(parts) - 1) < 1e-6
    assert model.infer([text(r, "xb", 200)], 3.0, 12)[0][2] == ["xb"]


def test_batches_give_what_single_texts_give(model):
    r = random.Random(4)
    texts = [text(r, r.choice(sorted(SYLLABLES)), r.randint(1, 40)) for _ in range(50)] + [None, "a"]
    together = model.infer(texts, 3.0, 12)
    alone = [model.infer([t], 3.0, 12)[0] for t in texts]
    assert [(x[0], x[2]) for x in together] == [(x[0], x[2]) for x in alone]
    assert np.allclose([x[1] for x in together], [x[1] for x in alone])


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.learned(empty, F.lit(True))
    assert [x.lang_pred for x in language_id.identified(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]
    assert language_id.identified(empty, model).count() == 0


def test_mixture_equals_plain_em():
    import numpy as np

    from lexalloy.llm import language_id as li

    r = np.random.default_rng(3)
    languages, buckets = ("a", "b", "c"), 512
    table = r.dirichlet(np.full(buckets, 0.05), 3).T + 1e-6
    model = li.Model(languages, np.log(table / table.sum(axis=0)))
    alphabets = ("abcde", "fghij", "klmno")
    texts = [" ".join("".join(r.choice(list(alphabets[r.choice(3, p=p)]), 5)) for _ in range(60)) for p in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5], [0, 0, 1])]
    for text, (name, score, chosen, shares) in zip(texts, model.infer(texts, 3.0, 12), strict=True):
        grams = li.hashed_grams([li.normal_form(text)], buckets)[1].tolist()
        like = np.exp(model.log_likelihood)

        def em(allowed, rounds):
            p = np.array([1.0 if j in allowed else 0.0 for j in range(3)]) / len(allowed)
            for _ in range(rounds):
                new = np.zeros(3)
                for g in grams:
                    share = p * like[g]
                    new += share / share.sum()
                p = new / len(grams)
            return p, sum(np.log((p * like[g]).sum()) for g in grams)

        order = np.argsort(-em((0, 1, 2), 12)[0], kind="stable").tolist()
        best = None
        for k in (1, 2, 3):
            p, fit = em(order[:k], 12 if k > 1 else 0)
            value = fit - 3.0 * k * (1 + 0.5 * np.log(len(grams)))
            if best is not None and value <= best[0]:
                break
            best = (value, p, k)
        want = sorted(((best[1][j], languages[j]) for j in order[: best[2]]), key=lambda x: (-x[0], x[1]))
        assert [n for _, n in want] == chosen and np.allclose([s for s, _ in want], shares, atol=1e-6) and name == want[0][1] and abs(score - want[0][0]) < 1e-6


def test_what_counts_as_a_letter(model):
    for text in ("½ ²", "Ⅷ", "٣ 12", "_", "①②", "", "…", "༳"):
        assert model.infer([text], 3.0, 12)[0][0] == "und", text
    for text in ("ª", "中", "가", "ñ", "²a", "ʰ", "א"):
        assert model.infer([text], 3.0, 12)[0][0] != "und", text
    assert language_id.normal_form("a½b Ⅷ c") == " a b c "


def test_many_languages_in_pages(spark):
    """More languages than a page holds, and the same answers as from a matrix."""
    r = random.Random(7)
    names = [f"l{i:03}" for i in range(230)]
    words = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in names}
    say = lambda n, k: " ".join(r.choice(words[n]) for _ in range(k))
    docs = spark.createDataFrame([(i, say(n, 40), n) for i, n in enumerate(names * 2)], "doc_id long, text string, lang string")
    paged, whole = language_id.learned(docs, F.lit(True)), language_id.learned(docs, F.lit(True), dense=1000)
    assert paged.sparse is not None and whole.sparse is None and len(paged.languages) == 230
    texts = [say(n, 30) for n in names[::10]] + [say("l001", 60) + " " + say("l200", 30)]
    a, b = paged.infer(texts, 3.0, 12), whole.infer(texts, 3.0, 12)
    assert [x[0] for x in a] == names[::10] + ["l001"] and a[-1][2] == ["l001", "l200"]
    assert [(x[0], x[2]) for x in a] == [(x[0], x[2]) for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
