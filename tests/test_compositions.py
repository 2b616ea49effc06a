"""What is put together from several operators, by worked examples and plain versions."""

import random
import re
from html.parser import HTMLParser
from math import log

import pytest
from pyspark.sql import functions as F

from lexalloy.functions import assembly, pages
from lexalloy.functions import text as tx
from lexalloy.operators import evaluation, features, feed, matching, models, training
from lexalloy.plans import composition_queries
from lexalloy.sources import runs

FIELDS = "title string, content string, brands array<string>, source string, topics array<string>"


def assembled(spark, row):
    f = [F.col(c) for c in ("title", "content", "brands", "source", "topics")]
    made = {"training": assembly.training_text(*f), "emphasised": assembly.emphasised_text(*f[:3], reach=2), "raw": assembly.raw_text(*f), "labelled": assembly.labelled_text(*f), "weighted": assembly.weighted_text(*f), "prefix": assembly.metadata_prefix(f[3], f[4])}
    return spark.createDataFrame([row], FIELDS).select(*[c.alias(k) for k, c in made.items()]).first()


def test_assemblies(spark):
    got = assembled(spark, ("A Big Day!", "Then came Nike, with new shoes for all.", ["Nike"], "wwd.com", ["business", "sports"]))
    assert got.prefix == "wwd.com business sports "
    assert got.training == "wwd.com business sports big day big day nike then came nike with new shoes for all"
    assert got.emphasised == "big day big day nike then came nike with new shoes for all then came with new"
    assert got.raw == "wwd.com business sports A Big Day! Then came Nike, with new shoes for all. Nike"
    assert got.labelled == "Source wwd.com Category business sports A Big Day! Then came Nike, with new shoes for all. Nike"
    assert got.weighted == "wwd.com business sports big day big day nike then came nike with new shoes for all"


def test_assemblies_of_blank_fields(spark):
    got = assembled(spark, (None, None, None, None, None))
    assert (got.prefix, got.training, got.emphasised, got.raw, got.labelled, got.weighted) == ("", " ", " ", "", "", "")
    got = assembled(spark, ("", "Some text", [], "", [None, ""]))
    assert (got.prefix, got.training, got.raw, got.weighted) == ("", "   some text", "Some text", "some text")
    assert assembled(spark, ("T", "x", ["A", None], "s", None)).raw == "s T x A"


def test_words_around_a_rows_own_names(spark):
    rows = spark.createDataFrame([("One Nike two three Puma four", ["nike"]), ("one nike", None), (None, ["nike"])], "t string, n array<string>")
    assert [r.x for r in rows.select(tx.words_around(F.col("t"), F.col("n"), 1).alias("x")).collect()] == ["one two", "", ""]


def test_brand_warning(spark):
    rows = spark.createDataFrame([([], ["a", "b", "c", "d"]), ([], ["a"]), (["a"], ["a"]), ([], []), (None, None)], "f array<string>, e array<string>")
    got = [r.x for r in rows.select(tx.brand_warning(F.col("f"), F.col("e")).alias("x")).collect()]
    assert got == ["none of the expected names is in the text: a, b, c, ...", "none of the expected names is in the text: a", None, None, None]


def test_choices_are_even_and_the_same_again(spark):
    ids = spark.range(6_000)
    pick = lambda seed: ids.repartition(3).select("id", tx.chosen(["a", "b", "c"], F.col("id"), seed).alias("x"))
    first = {r.id: r.x for r in pick(1).collect()}
    assert first == {r.id: r.x for r in pick(1).collect()} and first != {r.id: r.x for r in pick(2).collect()}
    assert all(1_800 < list(first.values()).count(x) < 2_200 for x in "abc")
    row = spark.createDataFrame([(list("abcdefgh"), None)], "x array<string>, y array<string>").select(tx.shuffled(F.col("x"), 3).alias("a"), tx.shuffled(F.reverse("x"), 3).alias("b"), tx.shuffled(F.col("x"), 4).alias("c"), tx.shuffled(F.col("y")).alias("d")).first()
    assert row.a == row.b and row.a != row.c and sorted(row.a) == list("abcdefgh") and row.d is None


class Reader(HTMLParser):
    """The blocks of a page by Python's parser: text, characters, linked characters, other tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.link, self.skip = [], ["", "", 0], False, 0

    def cut(self):
        text, linked = (" ".join(x.split()) for x in self.now[:2])
        if text:
            self.blocks.append((text, len(text), len(linked), self.now[2]))
        self.now = ["", "", 0]

    def tag(self, name, opens):
        if name in ("script", "style", "head"):
            self.skip += 1 if opens else -1
        elif self.skip:
            return
        elif name in ("p", "div", "ul", "li", "nav", "article", "body", "html", "h1", "br", "footer"):
            self.cut()
        elif name == "a":
            self.link, self.now[2] = opens, self.now[2] + opens
        else:
            self.now[2] += 1

    def handle_starttag(self, name, _):
        self.tag(name, True)

    def handle_endtag(self, name):
        self.tag(name, False)

    def handle_data(self, data):
        if not self.skip:
            self.now[0] += data
            self.now[1] += data if self.link else ""


def page(rng):
    words = lambda n: " ".join(rng.choice(("river", "stone", "a &amp; b", "light", "year")) for _ in range(n))
    links = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(rng.randint(1, 9)))
    body = "".join(rng.choice((f"<p>{words(rng.randint(5, 60))} <b>{words(2)}</b></p>", f"<p>{words(rng.randint(1, 4))}<br>{words(20)}</p>", f'<div><a href="x">{words(9)}</a> {words(1)}</div>')) for _ in range(rng.randint(1, 8)))
    return f"<html><head><title>{words(3)}</title><style>p{{x}}</style></head><body><nav><ul>{links}</ul></nav><!-- <p>no</p> --><script>var t='</p>';</script><article><h1>{words(4)}</h1>{body}</article><footer>{words(3)} <a href='y'>{words(2)}</a></footer></body></html>"


def test_blocks_and_main_text_against_a_parser(spark):
    rng = random.Random(5)
    made = [page(rng) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(made)), "i int, h string").select("i", pages.blocks(F.col("h")).alias("b"), pages.main_text(F.col("h")).alias("t")).orderBy("i").collect()
    for html, row in zip(made, got, strict=True):
        reader = Reader()
        reader.feed(html)
        reader.cut()
        assert [tuple(b) for b in row.b] == reader.blocks
        density = [log(1 + max(n - linked, 0) / (tags + 1)) for _, n, linked, tags in reader.blocks]
        mean = sum(b[1] * d for b, d in zip(reader.blocks, density, strict=True)) / sum(b[1] for b in reader.blocks)
        score = [(2 * d + (density[i - 1] if i else 0) + (density[i + 1] if i + 1 < len(density) else 0)) / 4 for i, d in enumerate(density)]
        assert row.t == "\n".join(b[0] for b, s in zip(reader.blocks, score, strict=True) if s >= 0.5 * mean and 2 * b[2] < b[1])


def test_main_text_of_odd_pages(spark):
    long = "A sentence that goes on for a while, so that it is dense enough to be kept as text. "
    rows = [(None,), ("",), ("just text",), ("<p></p><div> </div>",), (f"<nav><a href=1>Home</a> <a href=2>News</a></nav><p>{long * 3}</p><div><a href=3>{long}</a></div><p>{long}</p>",), ("<a>only links</a>",)]
    got = [r.x for r in spark.createDataFrame(rows, "h string").select(pages.main_text(F.col("h")).alias("x")).collect()]
    assert got == ["", "", "just text", "", f"{(long * 3).strip()}\n{long.strip()}", ""]


def test_runs(spark, tmp_path):
    path, rows = str(tmp_path / "runs"), spark.createDataFrame([(True, 3), (False, 4), (True, None)], "ok boolean, tokens int")
    runs.started(spark, path, "a", "labelling", {"model": "m", "batch": 2})
    runs.started(spark, path, "b", "labelling")
    runs.completed(rows, path, "a", "labelling", {"handled": F.count("*"), "good": F.count_if("ok"), "tokens": F.sum("tokens")})
    runs.completed(rows.limit(0), path, "c", "labelling", {"tokens": F.sum("tokens")}, "failed", "no rows")
    got = {r.run_id: r for r in runs.runs(spark, path).withColumn("cost", runs.cost(F.col("counters"), {"tokens": 0.5, "other": 9.0})).collect()}
    assert (got["a"].status, got["a"].counters, got["a"].config, got["a"].cost) == ("success", {"handled": 3, "good": 2, "tokens": 7}, '{"batch": 2, "model": "m"}', 3.5)
    assert got["a"].seconds >= 0 and got["a"].started_at <= got["a"].completed_at
    assert (got["b"].status, got["b"].completed_at, got["b"].counters, got["b"].cost) == ("running", None, None, 0.0)
    assert (got["c"].status, got["c"].error, got["c"].started_at, got["c"].counters) == ("failed", "no rows", None, {"tokens": 0})
    runs.completed(rows, path, "b", "labelling", {}, "partial")
    assert {r.run_id: r.status for r in runs.runs(spark, path).collect()} == {"a": "success", "b": "partial", "c": "failed"}


def test_nested_evidence(spark):
    labels = spark.createDataFrame([(1, "x", "env", True), (1, "x", "env", True), (1, "x", "soc", False), (1, "y", "soc", True), (2, "x", "env", None), (3, "z", "env", True)], "article_id int, brand string, category string, applies boolean")
    matches = spark.createDataFrame([(1, "x", "env", 5, 50, 0.5), (1, "x", "env", 4, None, None), (1, "x", "soc", 6, 50, 1.0), (1, "y", "soc", 7, 51, 1.0), (2, "x", "env", 8, 52, 1.0)], "article_id int, brand string, category string, excerpt_id int, chunk_id int, similarity double")
    got = {r.article_id: {b: {c: [tuple(m) for m in v] for c, v in d.items()} for b, d in r.brands.items()} for r in matching.nested(labels, matches).collect()}
    assert got == {1: {"x": {"env": [(4, None, None), (5, 50, 0.5)]}, "y": {"soc": [(7, 51, 1.0)]}}}
    assert matching.nested(labels.limit(0), matches).count() == 0


def test_keyword_scores(spark):
    groups = {"goods": {"sale": (("sale", "deal"), 2.0), "new": (("launch",), 1.5)}, "people": {"star": (("athlete",), 1.5)}}
    scores = features.keyword_scores(F.col("t"), groups, {"goods": ("sale", "deal", "shoe", "shoe"), "people": ("athlete",)}, ("climate", "waste"), {"any_kind": ("new", "star")})
    rows = [r.s for r in spark.createDataFrame([("Big SALE on shoes for the climate",), ("An athlete at a launch",), ("",), (None,), ("nothing here",)], "t string").select(scores.alias("s")).collect()]
    a, b, *others = rows
    assert (a.n_goods, a.is_sale, a.is_new, a.score_goods, a.n_people, a.score, a.own_share, a.any_any_kind) == (2, 1, 0, 2.0, 0, 2.0, pytest.approx(1 / 3), 0)
    assert a.density_goods == pytest.approx(100 * 2 / 7)
    assert (b.is_new, b.is_star, b.score_goods, b.score_people, b.score, b.own_share, b.any_any_kind) == (1, 1, 1.5, 1.5, 3.0, 0.0, 1)
    assert all((r.n_goods, r.density_goods, r.score, r.own_share) == (0, 0.0, 0.0, 0.5) for r in others)


def test_publishers(spark):
    block = features.publisher_block(F.col("s"), F.col("c"), {"green": ("Earth.org",)}, {"business": "business"}, {"soft": ("life", "food")}, (("news.earth.org", 0.2), ("earth.org", 0.9)))
    rows = spark.createDataFrame([("www.EARTH.org", ["Business", "Life", "life"]), ("news.earth.org", None), (None, [None, "food"])], "s string, c array<string>")
    assert [tuple(r) for r in rows.select(*[c.alias(k) for k, c in block.items()]).collect()] == [(1, 1, 2, 0.9), (1, 0, 0, 0.2), (0, 0, 1, 0.35)]


def test_window_terms_are_of_the_windows_alone(spark):
    docs = spark.createDataFrame([(1, "far away aa bb nike cc dd far away"), (2, "aa nike cc"), (3, "far away"), (4, None)], "id int, t string")
    got = features.window_terms(docs, "id", "t", ["nike"], 2, min_df=2, max_df=1.0)
    assert {(r.id, r.term) for r in got.collect()} == {(i, w) for i in (1, 2) for w in ("aa", "nike", "cc")}


def test_pivot(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 2), ("a", "x", 9.0, 1), ("a", "y", 3.0, 1), ("b", "z", 4.0, 1), ("c", None, 5.0, 1)], "i string, c string, v double, o int")
    got = {r.i: (r.v_x, r.v_y) for r in evaluation.pivoted(rows, "i", "c", ("x", "y"), ("v",), F.col("o")).collect()}
    assert got == {"a": (9.0, 3.0), "b": (None, None), "c": (None, None)}


def test_validation(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.1, 1), (0.5, 0)], "probability double, y int")
    r = evaluation.validated(rows, label="y").first()
    assert (r.n_samples, r.n_positive, r.n_invalid, r.success, r.accuracy) == (3, 2, 0, True, pytest.approx(1 / 3))
    more = rows.unionByName(spark.createDataFrame([(None, 1), (1.5, None), (float("nan"), 0)], rows.schema))
    r = evaluation.validated(more, label="y").first()
    assert (r.n_invalid, r.success, r.accuracy) == (3, False, None)
    r = evaluation.validated(rows.limit(0), label="y").first()
    assert (r.n_samples, r.n_positive, r.success, r.accuracy) == (0, 0, False, None)
    assert evaluation.validated(rows).first().accuracy is None


def test_curves(spark):
    fits = [(d, f, p, v) for d, (train, test) in {2: (0.70, 0.60), 4: (0.80, 0.75), 8: (0.95, 0.75), 16: (None, None)}.items() for f in (0, 1) for p, v in (("train", train), ("test", test))]
    got = {r.depth: r for r in models.parameter_curve(spark.createDataFrame(fits, "depth int, fold int, part string, f_beta double"), "depth").collect()}
    assert [got[d].is_best for d in (2, 4, 8, 16)] == [False, True, False, False] and [got[d].past_best for d in (2, 4, 8, 16)] == [False, False, True, True]
    assert got[2].gain is None and got[4].gain == pytest.approx(0.15) and got[8].verdict == "severe" and got[4].verdict == "moderate"


def test_gap_summaries_and_advice(spark):
    runs_ = spark.createDataFrame([(0, "forest", 0.9, 0.7), (1, "forest", 0.8, 0.78), (2, "logistic", 0.5, 0.46), (3, "svm", None, None)], "run int, estimator string, mean_train double, mean_test double")
    got = {r.estimator: r for r in models.advised(models.gap_summary(runs_), {("logistic", "moderate"): "smaller C"}, default="fine").collect()}
    assert set(got) == {"forest", "logistic"} and got["forest"].run == 1 and got["forest"].gap_share == pytest.approx(0.025)
    assert (got["logistic"].verdict, got["logistic"].advice, got["forest"].verdict, got["forest"].advice) == ("moderate", "smaller C", "good", "fine")
    assert [r.run for r in models.top_runs(runs_, 2).collect()] == [1, 0]


def test_rechunk_scan_and_deletion(spark):
    articles = spark.createDataFrame([(1, "labeled"), (2, "labeled"), (3, "pending"), (4, "labeled")], "id int, labeling_status string")
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, article_id int")
    evidence = spark.createDataFrame([(1, 100), (1, None), (2, 999)], "article_id int, chunk_id int")
    chunks = spark.createDataFrame([(100, 1), (101, 1), (200, 2), (300, 3)], "id int, article_id int")
    found = feed.to_rechunk(articles, labels, evidence, chunks)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, 2, 0, False), (2, 1, 1, 1, 1, True), (4, 0, 0, 0, 0, True)}
    assert [r.id for r in feed.to_rechunk(articles, labels, evidence, chunks, only=[2]).collect()] == [2]
    assert {r.id for r in feed.without_chunks(chunks, found.filter("needed")).collect()} == {100, 101, 300}


def test_feature_methods_from_configurations():
    assert training.method_from({}) == training.Method()
    assert training.method_from({"method": "latent", "max_features": "500", "components": 8}) == training.Method(components=8, max_features=500)
    assert training.method_from({"method": "numbers", "numbers": ["a", "b"]}) == training.Method(text=None, numbers=("a", "b"))
    for wrong in ({"method": "magic"}, {"colour": 1}, {"grams": "two"}, {"method": "numbers"}):
        with pytest.raises(ValueError):
            training.method_from(wrong)


def test_addresses_go_as_their_pattern_says(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("a1B@@. \n\té-") for _ in range(r.randint(0, 24))) for _ in range(300)] + ["@ a@ @a a@@ @@a x", "www.a@b c@d http://e@f g", None, "@" + "x" * 60_000 + " y zz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x for x in rows.select("i", tx.cleaned(F.col("t")).alias("a"), tx.cleaned(F.col("t"), False, True).alias("b"), tx.cleaned_with_punctuation(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        bare = re.sub(r"[^ \t\n]+@[^ \t\n]+" if len(text or "") < 1_000 else "$^", " ", re.sub(r"(https?://|www\.)[^ \t\n]+", " ", (text or "").lower()))
        words = re.sub(r"[^a-z0-9\s]", " ", bare).split()
        assert got[i].a == " ".join(w for w in words if len(w) > 1) and got[i].b == " ".join(re.sub(r"\d", " ", " ".join(words)).split())
        assert got[i].c == re.sub(r"\s+", " ", bare.replace("@", " ")).strip(" ")


def test_words_around_many_names_are_those_of_all_pairs(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["nike", "Puma", "a", "b", "c"] if i else ["nike"] * 9 + ["x"]) for _ in range(r.randint(0, 30) if i else 5_000)), r.choice([["Nike"], ["nike", "puma"], ["Puma", None], []]) if i else ["nike"]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t string, n array<string>")
    got = {x.i: x for x in df.select("i", tx.words_around(F.col("t"), F.col("n"), 2).alias("own"), tx.words_around(F.col("t"), ["Puma", "nike"], 2).alias("given")).collect()}
    for i, text, names in rows:
        words = text.lower().split()
        near = lambda own: " ".join(w for k, w in enumerate(words) if w not in own and any(v in own for v in words[max(0, k - 2) : k + 3]))  # noqa: E731, B023
        assert (got[i].own, got[i].given) == (near([n.lower() for n in names if n]), near(["puma", "nike"]))


def test_assemblies_clean_each_field_once(spark):
    df = composition_queries.QUERIES["tx_09_assemblies"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # each stands in both branches of one CASE, and the text once more where words near names are looked for
    assert [len(re.findall(rf"lower\(coalesce\({c}#\d+, \)\)", plan)) for c in ("title", "text")] == [2, 3]
    fields = [F.col(c) for c in ("title", "content", "brands", "source", "topics")]
    rows = spark.createDataFrame([("A Big Day!", "So nike came, with x@y.z new shoes", ["Nike"], "s", ["t"]), (None, None, None, None, None), ("", "text", [], "", [None])], FIELDS)
    shared, clean = assembly.with_cleaned(rows, *fields[:3], reach=1)
    pairs = [(assembly.training_text(*fields), assembly.training_text(*fields, clean=clean)), (assembly.emphasised_text(*fields[:3], reach=1), assembly.emphasised_text(*fields[:3], clean=clean)), (assembly.weighted_text(*fields), assembly.weighted_text(*fields, clean=clean))]
    assert all(x.ok for x in shared.select(F.forall(F.array(*[a.eqNullSafe(b) for a, b in pairs]), lambda x: x).alias("ok")).collect())
