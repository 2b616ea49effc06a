import random

from pyspark.sql import functions as F

from lexalloy.llm import toxicity

VOCABULARY = ["".join(p) for p in (("th", "an"), ("er", "ed"), ("on", "es"), ("the",), ("of",), ("rest", "in"), ("lose",), ("mar", "ine"), ("clas", "sic"))]


def corpus(n=300, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(VOCABULARY) + r.choice(["", "a", "th"]) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["vilebag", "grubling", "zorka" + r.choice(["n", "ss", "mat", "lik", "ter"])]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def learn(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return toxicity.learned(docs, labels, F.lit(True))


def predict(spark, lexicon, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.predicted for r in toxicity.scored(docs, lexicon).orderBy("doc_id").collect()]


def test_learned_lexicon_catches_new_endings_and_disguises(spark):
    lexicon = learn(spark, corpus())
    clean = "thana the of ered the of ones restin the of a " * 3
    toxic = [clean + w + " the of" for w in ("vilebag", "VILEBAG!", "v1lebag", "vileb@g", "vіlebаg", "zorkanew", "GRUBL1NG")]
    assert predict(spark, lexicon, toxic) == [1] * len(toxic)
    assert predict(spark, lexicon, [clean, "", None, "marine classic lose", "unvilebag the of"]) == [0] * 5


def test_exceptions_cancel_matches(spark):
    lexicon = toxicity.Lexicon({"grub": 5.0}, exceptions=frozenset({"grub screw"}), slope=5.0, offset=-4.0)
    assert predict(spark, lexicon, ["a grub", "a grub screw", "a grub screw grub"]) == [1, 0, 1]


def test_without_both_labels(spark):
    rows = corpus(20)
    assert predict(spark, learn(spark, [(i, t, 0) for i, t, _ in rows]), ["a", None]) == [0, 0]
    assert predict(spark, learn(spark, []), ["a"]) == [0]


def test_folding(spark):
    texts = ["Ｉd1о7", "a|b !x x! 3a b@c", None]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(toxicity.folded(F.col("t")).alias("f")).collect()]
    assert got == ["idiot", "aib !x x! 3a bac", ""]


def test_exceptions_hold_in_any_order_and_edges_have_results(spark):
    lexicon = toxicity.Lexicon({"bad": 2.0, "awful": 1.0}, frozenset({"bad"}), frozenset({"bad apple", "badminton", "so awful it"}), 1.0, -1.0)
    plain = lambda t: sum({"bad": 2.0, "awful": 1.0}[w] for w in t)
    assert lexicon.matched("bad apple badminton bad so awful it awful") == plain(["bad", "awful"])
    assert lexicon.matched("bad apple " * 20_000 + "bad") == 2.0
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "bad " * 30_000, "z")], "doc_id long, text string, score string")
    found = toxicity.scored(docs, lexicon).collect()
    assert len(found) == 4 and found[0].score == found[1].score == found[2].score < found[3].score and found[3].predicted == 1
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_contexts_are_distinct_pairs(spark):
    docs = spark.createDataFrame([("a b a b c",), ("",), ("x",)], "t string")
    rows = [[tuple(p) for p in r[0]] for r in docs.select(toxicity.contexts_of(docs.t)).collect()]
    assert rows == [[("a", "b"), ("b", "a"), ("b", "c"), ("c", "")], [], [("x", "")]]


def test_thousands_of_stems(spark):
    """The lexicon's size doesn't reach any plan: 1,500 stems, each with clean words under it."""
    from itertools import product

    from lexalloy.llm import toxicity

    stems = ["".join(p) + "qz" for p in product("bdfgkm", "aeu", "nprtv", "aeoukgbdmnprtvfhj")][:1500]
    rows, labels = [], []
    for i, s in enumerate(stems):
        for j, end in enumerate(("er", "ut", "on", "ak")):
            rows.append((len(rows), f"w{i % 7}{j} {s}{end} v{i % 11} {s}{end} u{j} {s}{end} t{i % 5} {s}{end}"))
            labels.append((len(labels), 1))
    for i in range(2000):
        rows.append((len(rows), f"plain words w{i % 7} and v{i % 11} {stems[i % 1500]}clean here"))
        labels.append((len(labels), 0))
    lexicon = toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), min_contexts=2, min_texts=2, min_precision=0.6)
    assert len(lexicon.stems) > 1000 and len(lexicon.exceptions) > 1000
    assert sorted(toxicity.under_stems(spark.createDataFrame([("abcdefgh",), ("abcx",), ("abc",), ("zzzzzz",)], "w string"), ["abcd", "abcx"], (4, 8))) == ["abcdefgh", "abcx"]


def test_words_are_counted_by_any_space(spark):
    from lexalloy.llm import toxicity

    texts = spark.createDataFrame([("a b\tc  d\n\ne ",), ("",)], "f string")
    assert [r.m.words for r in texts.select(toxicity.matches(F.col("f"), toxicity.Lexicon({})).alias("m")).collect()] == [5, 0]
