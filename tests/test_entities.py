import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.operators import entities, matching, tagger
from lexalloy.plans import operator_queries

ENTITIES = "array<struct<label:string,start:int,end:int,text:string>>"
SEEDS = (tagger.Seed("ORG", r"(?<=at )[A-Z]\w+(?: Inc)?"), tagger.Seed("MONEY", r"\$ ?\d+"))


def model(spark, texts, seeds=SEEDS, spans=True):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return tagger.fitted(rows.select(F.explode(tagger.labelled(F.col("t"), seeds, spans)).alias("s")), "s")


def test_viterbi_finds_the_best_of_all_paths_in_any_block():
    r = np.random.default_rng(3)
    m = tagger.Tagger(("A", "B", "C"), *(np.log(r.random(s)) for s in ((3,), (3, 3))), {}, np.log(r.random((6, 3))))
    sequences = [r.integers(0, 6, n) for n in (0, 1, 5, 2, 7, 5, 1)]

    def value(rows, path):
        return m.first[path[0]] + sum(m.following[a, b] for a, b in itertools.pairwise(path)) + sum(m.emitted[x, k] for x, k in zip(rows, path, strict=True))

    found = m.best(sequences)
    for rows, path in zip(sequences, found, strict=True):
        best = max(itertools.product(range(3), repeat=len(rows)), key=lambda p: value(rows, p)) if len(rows) else ()
        assert tuple(path) == best and tuple(m.best([rows])[0]) == best


def test_tagger_learns_from_seeds_and_carries_over(spark):
    names = ["Alder", "Birch", "Cedar", "Dogwood", "Elm"]
    texts = [f"She works at {n} Inc since spring. They paid $ {i} for it." for i, n in enumerate(names * 6)] + [None, "", "Nothing here."]
    m = model(spark, texts)
    assert set(m.tags) == {"B-MONEY", "I-MONEY", "B-ORG", "I-ORG", "O"}
    text = "He works at Fir Inc since spring. They paid $ 99 for it."
    got = m.entities([text, "", None])
    assert [(e["label"], e["text"]) for e in got[0]] == [("ORG", "Fir Inc"), ("MONEY", "$ 99")] and got[1:] == [[], []]
    assert all(text[e["start"] : e["end"]] == e["text"] for e in got[0])
    other = tagger.fitted(spark.createDataFrame([(t,) for t in reversed(texts)], "t string").repartition(3).select(F.explode(tagger.labelled(F.col("t"), SEEDS)).alias("s")), "s")
    assert other.rows == m.rows and np.array_equal(other.emitted, m.emitted) and np.array_equal(other.following, m.following)


def test_tagger_of_nothing_and_shapes(spark):
    m = model(spark, [None, ""])
    assert m.tags == ("O",) and m.entities(["Some text."]) == [[]]
    assert tagger.shapes("Running") == ("\tcapital ng", "\tcapital") and tagger.shapes("3.5")[1] == "\tnumber" and tagger.shapes("%")[1] == "\tmark"
    assert [[w[0] for w in s] for s in tagger.sentences("A b. C\nd, e-f")] == [["A", "b", "."], ["C"], ["d", ",", "e-f"]]


def test_near_names_equal_all_pairs(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        text = "".join(r.choice(["ab", "AB", "xyz", " ", "İ", "q"]) for _ in range(r.randint(0, 40)))
        spans = [(a, a + r.randint(1, 4)) for a in sorted(r.sample(range(80), r.randint(0, 8)))]
        rows.append((i, text, r.choice([["ab", "xyz"], ["xyz"], [], ["Ab", ""]]), [("X", a, b, "x") for a, b in spans]))
    df = spark.createDataFrame(rows, f"id int, text string, names array<string>, e {ENTITIES}")
    got = {x.id: [list(e.near) for e in x.n] for x in df.select("id", entities.near_names(F.col("text"), F.col("names"), F.col("e"), 6).alias("n")).collect()}
    for i, text, names, found in rows:
        low = entities.folded(text)
        spots = {n: [(p, p + len(n)) for p in range(len(low)) if n and low.startswith(n.lower(), p)] for n in names}  # neither name overlaps itself
        assert got[i] == [[n for n in names if any(abs(a - q) <= 6 or abs(b - p) <= 6 for p, q in spots[n])] for _, a, b, _ in found]


def test_blocks_and_their_defaults(spark):
    text = "Manor Salomon met people in Columbia where vans stop. " + "z " * 60 + "Acme Corp gave $5."
    found = [("PERSON", 0, 13, "Manor Salomon"), ("GPE", 28, 36, "Columbia"), ("ORG", text.index("Acme"), text.index("Acme") + 9, "Acme Corp"), ("MONEY", text.index("$"), len(text) - 1, "$5")]
    rows = [(1, text, ["Salomon", "Columbia Wear", "Vans"], found), (2, None, None, None), (3, "", [], []), (4, text, [], found)]
    df = spark.createDataFrame(rows, f"id int, text string, names array<string>, e {ENTITIES}").withColumn("e", entities.near_names(F.col("text"), F.col("names"), F.col("e"), 20))
    near = entities.near_block(F.col("e"), ("PERSON", "GPE"), ("ORG", "MONEY"), {"has_person": ("PERSON",), "has_place": ("GPE", "LOC"), "has_org": ("ORG",)})
    collision = entities.collision_block(F.col("text"), F.col("names"), F.col("e"), ["Salomon"], ["columbia"], ["Vans"])
    block = near | collision | entities.document_block(F.col("e"))
    assert (len(near), len(collision), len(block)) == (6, 8, 20)
    got = {r.id: r.asDict() for r in df.select("id", *[c.alias(k) for k, c in block.items()]).collect()}
    assert got[1] == {"id": 1, "n_against": 2, "n_towards": 0, "share_against": 1.0, "has_person": 1, "has_place": 1, "has_org": 0, "person_near": 1, "place_near": 0, "common_in_lower_case": 1, "person_named": 1, "place_named": 1, "common_named": 1, "n_person_near": 1, "name_in_person": 1, "n_org": 1, "n_money": 1, "n_percent": 0, "n_date": 0, "n_place": 1, "has_figures": 1}
    empty = {k: 0 for k in block} | {"share_against": 0.5}
    assert got[2] == empty | {"id": 2} and got[3] == empty | {"id": 3}
    assert got[4] == empty | {"id": 4, "n_org": 1, "n_money": 1, "n_place": 1, "has_figures": 1}
    report = {(r["class"], r.label): r.n for r in entities.label_report(df, "id", "e").collect()}
    assert report == {(1, "PERSON"): 1, (1, "GPE"): 1}


def test_speech_block_counts_what_a_walk_counts(spark):
    r, rows = random.Random(9), []
    for i in range(80):
        n = r.randint(0, 25)
        rows.append((i, [(r.choice(["nike", "a", "run", "shoe"]), r.choice(["NN", "NNP", "NNS", "VBD", "VB", "JJ", "DT"])) for _ in range(n)], r.choice([["Nike"], [], ["shoe", "nik"], None])))
    rows.append((80, None, ["Nike"]))
    df = spark.createDataFrame(rows, "id int, w array<struct<word:string,tag:string>>, names array<string>")
    got = {x.id: tuple(x.s) for x in df.select("id", entities.speech_block(F.col("w"), F.col("names"), 3).alias("s")).collect()}
    for i, words, names in rows:
        want = [0] * 5
        for k, (word, _) in enumerate(words or []):
            if any(n.lower() in word or word in n.lower() for n in names or []):
                around = range(max(0, k - 3), min(len(words), k + 4))
                want[0] += k + 1 < len(words) and words[k + 1][1] in ("NN", "NNS")
                want[1] += k > 0 and words[k - 1][1][:2] == "VB"
                want[2] += k > 0 and words[k - 1][1][:2] == "JJ"
                want[3] += sum(words[j][1] in ("VBD", "VBZ", "VBP") for j in around)
                want[4] += sum(words[j][1][:2] in ("VB", "JJ", "NN") and words[j + 1][1][:2] == "NN" for j in around if j + 1 in around)
        assert got[i] == tuple(want)


def test_best_ratio_skips_no_better_part(spark):
    r = random.Random(2)
    for _ in range(40):
        excerpt, parts = "".join(r.choices("abcd ", k=30)), ["".join(r.choices("abcde ", k=r.randint(0, 60))) for _ in range(8)]
        assert matching.best_ratio(excerpt, parts) == max(matching.best_ratio(excerpt, [p]) for p in parts)
    long, middle = "lorem ipsum dolor " * 7, "x" * 40 + "lorem ipsum dolor " * 7 + "y" * 500
    rows = spark.createDataFrame([("abc", "abc"), ("", "abc"), ("abcdef", "abc"), (None, "a"), (" ABC ", "xabcx"), (long, middle)], "e string, t string")
    got = [x.s for x in rows.select(matching.fuzzy(F.col("e"), F.col("t")).alias("s")).collect()]
    assert got[:4] == [1.0, 0.0, 0.0, 0.0] and got[4] == pytest.approx(0.75)
    own = long.strip()
    assert got[5] == max(SequenceMatcher(None, own, middle[s : s + 2 * len(own)]).ratio() for s in range(0, len(middle) - 2 * len(own) + 1, len(own) // 4))
    parts = rows.filter(F.length("e") > 100).select(matching.compared(F.col("e"), F.col("t")).alias("p")).first().p
    assert {len(p) for p in parts} == {252} and len(parts) == (len(middle) - 252) // (len(long) // 4) + 1


@pytest.mark.parametrize("name", ["fe_13_entity_blocks", "fe_15_speech_block", "sd_05_entity_report"])
def test_queries_cover_their_tables(spark, name):
    found = operator_queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    if name == "sd_05_entity_report":
        assert len(found) and (found["n"] > 0).all()
    else:
        assert len(found) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and not found.isna().any().any()
        assert (found.drop(columns="doc_id").sum() > 0).sum() >= 3


def test_tags_leave_a_task_in_parts(spark):
    """A call gets a bounded number of characters, however many texts an Arrow batch holds, and each text keeps its result."""
    from lexalloy.sources import plugins

    assert list(plugins.parts(np.array([5, 9, 0, 1, 30, 2]), 10, 10)) == [(0, 1), (1, 4), (4, 5), (5, 6)] and list(plugins.parts(np.zeros(5), 2)) == [(0, 2), (2, 4), (4, 5)]
    size = lambda texts: [str(sum(map(len, texts)))] * len(texts)
    rows = spark.range(40).coalesce(1).select("id", F.repeat(F.lit("abcdefghij"), F.lit(20_000)).alias("t"))
    got = [int(r.n) for r in rows.select(plugins.Plugin("answer", size, 1_000).column(F.col("t")).alias("n")).collect()]
    assert len(got) == 40 and max(got) <= plugins.ROOM
    tokens = plugins.Plugin("tokens", lambda texts: [[{"word": t, "tag": "NN"}] for t in texts], 7)
    frame = spark.range(50).coalesce(1).select(F.col("id").cast("string").alias("t"))
    assert all(r.t == r.w[0].word for r in frame.select("t", tokens.column(F.col("t")).alias("w")).collect())


def test_words_of_many_texts_are_those_of_the_pattern():
    r = random.Random(4)
    texts = ["".join(r.choice("ab_é1٣-'’.,!?;  \n\t\x1c  İß😀\ud800") for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "", "a", "-", "\n"]
    found = tagger.words_of(texts)
    got: list[list[list[tuple]]] = [[] for _ in texts]
    for word, start, end, i, begins in zip(found.strings(), found.starts, found.ends, found.text, found.begins, strict=True):
        if begins:
            got[i].append([])
        got[i][-1].append((word, start - found.bases[i], end - found.bases[i]))
    for text, rows in zip(texts, got, strict=True):
        want, last = [], None
        for m in re.finditer(r"\w+(?:[-'’.,]\w+)*|[^\w\s]", text or ""):
            if last is None or last[0] in ".!?" or "\n" in text[last.end() : m.start()]:
                want.append([])
            want[-1].append((m[0], m.start(), m.end()))
            last = m
        assert rows == want == list(tagger.sentences(text))


def test_paths_are_the_same_in_blocks_of_any_size(monkeypatch):
    r = np.random.default_rng(8)
    m = tagger.Tagger(("A", "B", "C"), *(np.log(r.integers(1, 4, s)) for s in ((3,), (3, 3))), {}, np.log(r.integers(1, 4, (5, 3))))  # with many ties
    sequences = [r.integers(0, 5, n) for n in r.integers(0, 40, 300)]

    def walked(rows):
        score, came = m.first + m.emitted[rows[0]], []
        for row in rows[1:]:
            ways = score[:, None] + m.following
            came.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + m.emitted[row]
        path = [int(score.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1]

    want = [walked(s) if len(s) else [] for s in sequences]
    for kept in (1, 500, tagger._KEPT):
        monkeypatch.setattr(tagger, "_KEPT", kept)
        assert [p.tolist() for p in m.best(sequences)] == want
    assert m.best([]) == []


def test_a_word_is_looked_up_once(monkeypatch):
    asked, shapes = [], tagger.shapes
    monkeypatch.setattr(tagger, "shapes", lambda w: asked.append(w) or shapes(w))
    m = tagger.Tagger(("B-X", "O"), np.zeros(2), np.zeros((2, 2)), {"\tword": 0}, np.array([[0.0, -1.0], [-1.0, 0.0]]))
    found = m.entities(["new words. " * 500] * 3 + [None, "New!"])
    assert [len(f) for f in found] == [1000, 1000, 1000, 0, 0] and sorted(asked) == ["!", ".", "New", "new", "words"]
    assert found[2][999] == {"label": "X", "start": 5493, "end": 5498, "text": "words"}


def test_a_fit_makes_its_sentences_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf(tagger.SENTENCES)
    def told(text):
        made.add(1)
        return [[{"word": w, "tag": "X" if w == "b" else "O"} for w in text.split()]]

    m = tagger.fitted(spark.createDataFrame([("a b a",), ("b b",)], "t string").select(F.explode(told("t")).alias("s")), "s")
    assert made.value == 2 and m.tags == ("O", "X") and np.exp(m.first).round(3).tolist() == [0.5, 0.5]


def test_names_are_looked_for_in_one_lowered_text(spark):
    from lexalloy.functions import text as tx

    rows = spark.createDataFrame([("Nike's AIR max",), ("nikes, air-max",), ("ÉTÉ",), ("",), (None,)], "t string").select(tx.mentioned(F.col("t"), ["Nike", "air", "Max", "été"]).alias("m"))
    assert [r.m for r in rows.collect()] == [["Nike", "air", "Max"], ["air", "Max"], ["été"], [], []]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_a_fit_by_seeds_counts_every_text_as_its_sentences_do(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["at ", "Elm", "Inc ", "$ 5", "é1٣", "-", ". ", "\n", "İß ", "😀", "w"]) for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", " ", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for spans, default in ((True, "O"), (False, "XX")):
        got = tagger.fitted_by_seeds(rows, "t", SEEDS, spans, default)
        want = tagger.fitted(rows.select(F.explode(tagger.labelled(F.col("t"), SEEDS, spans, default)).alias("s")), "s")
        assert (got.tags, got.rows) == (want.tags, want.rows) and len(got.tags) > 2
        assert all(np.array_equal(a, b) for a, b in ((got.first, want.first), (got.following, want.following), (got.emitted, want.emitted)))


def test_taggers_of_queries_are_counted_from_all_documents(spark):
    docs = spark.range(12_000).select(F.concat(F.lit("w"), "id", F.lit(" w"), "id").alias("text"), F.col("id").alias("doc_id"))
    assert sum(k.startswith("w") for k in operator_queries._tagger(docs, SEEDS, True).rows) == 12_000
