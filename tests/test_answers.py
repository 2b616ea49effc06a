import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lexalloy.functions import answers
from lexalloy.functions import text as tx


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string') if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_times(spark):
    assert one(spark, answers.compact_timestamp(F.col("t")).cast("string"), t="20240131T235958Z") == "2024-01-31 23:59:58"
    for bad in ("", "20240131", "2024-01-31", "20241331T000000Z"):
        assert one(spark, answers.compact_timestamp(F.col("t")), t=bad) is None
    assert one(spark, answers.iso_timestamp(F.col("t")).cast("string"), t="2024-01-31T10:00:00Z") == "2024-01-31 10:00:00"
    assert one(spark, answers.iso_timestamp(F.col("t")).cast("string"), t="2024-01-31 10:00:00") == "2024-01-31 10:00:00"
    assert one(spark, answers.iso_timestamp(F.col("t")), t="nonsense") is None
    assert one(spark, answers.compact_text(F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5))), t="") == "20240102030405"


def test_records(spark):
    full = {"article_id": "1", "title": "T", "description": None, "content": "C", "link": "u", "pubDate": "2024-01-01T00:00:00Z", "language": "en", "country": ["us"]}
    a = one(spark, answers.article_of_a(F.col("r")), r=json.dumps(full))
    assert (a.article_id, a.url, a.search_text, a.country, a.category) == ("1", "u", "T  C", ["us"], None) and a.published_at is not None
    b = {"url": "http://a/b", "title": "T", "seendate": "20240101T000000Z", "domain": "a", "language": "English", "sourcecountry": "US", "socialimage": ""}
    x = one(spark, answers.article_of_b(F.col("r")), r=json.dumps(b))
    assert (x.url, x.language, x.country, x.image_url, x.source_url, x.search_text) == ("http://a/b", "english", ["US"], None, "https://a", "T")
    for bad in (b | {"url": ""}, b | {"title": None}, b | {"title": "  "}):
        assert one(spark, answers.article_of_b(F.col("r")), r=json.dumps(bad)) is None


def test_answers_are_repaired(spark):
    label = {"applies": True, "sentiment": 1, "evidence": ["q"]}
    single = {"brand": "A", "categories": {"social": label}, "confidence": 0.5, "reasoning": "why"}
    for text in (f"Sure:\n```json\n{json.dumps(single)}\n```", json.dumps(single)[:-1] + ",}"):
        got = one(spark, answers.answer(F.col("t")), t=text)
        assert got.article_summary == "why" and len(got.brand_analyses) == 1
        analysis = got.brand_analyses[0]
        assert set(analysis.categories) == set(answers.CATEGORIES) and analysis.categories["social"].evidence == ["q"] and analysis.categories["governance"].applies is False
    got = one(spark, answers.answer(F.col("t")), t=json.dumps({"brand_analyses": [single, {"brand": "B"}]}))
    assert got.article_summary == answers.NO_SUMMARY and got.brand_analyses[1].categories == {} and got.brand_analyses[1].confidence == 0.0
    for nothing in ("", "no json", '{"other": 1}'):
        assert one(spark, answers.answer(F.col("t")), t=nothing) is None


def test_answers_are_checked_and_looked_up(spark):
    whole = lambda **more: json.dumps({"brand_analyses": [{"brand": "A", "confidence": 0.5, "categories": {c: {"applies": c == "social", "sentiment": None, "evidence": []} for c in answers.CATEGORIES}} | more]})
    faults = lambda t: one(spark, F.transform(answers.answer(F.col("t")).brand_analyses, answers.faults), t=t)[0]
    assert faults(whole()) == [] and faults(whole(confidence=1.5)) == ["confidence"] and faults(whole(brand="")) == ["brand"]
    assert faults(whole(categories={c: {"applies": False, "sentiment": 3} for c in answers.CATEGORIES})) == ["sentiment"]
    assert one(spark, F.transform(answers.answer(F.col("t")).brand_analyses, answers.applicable), t=whole()) == [["social"]]
    assert one(spark, answers.analysis_of(answers.answer(F.col("t")), F.lit("a")).brand, t=whole()) == "A"
    assert one(spark, answers.analysis_of(answers.answer(F.col("t")), F.lit("z")), t=whole()) is None


def test_templates_terms_and_addresses(spark):
    assert one(spark, answers.filled_template("{a}-{b}-{a}", {"a": F.col("t"), "b": F.lit(None)}), t="x") == "x--x"

    def packed(terms, most, quoted):
        out, now = [], ""
        for t in terms:
            w = f'"{t}"' if quoted and " " in t else t
            longer = f"{now} OR {w}" if now else w
            if now and len(longer) > most:
                out.append(now)
                longer = w
            now = longer
        return [*out, now] if now else out

    r = random.Random(0)
    for quoted in (False, True):
        for n in (0, 1, 5, 30):
            terms = ["x" * r.randint(1, 12) + (" y" if r.random() < 0.3 else "") for _ in range(n)]
            assert one(spark, answers.packed_terms(F.col("t"), 40, quoted=quoted), t=terms) == packed(terms, 40, quoted)
    assert one(spark, answers.query_set(F.col("t"), ("k", "l")), t=["a OR b"]) == ["k AND (a OR b)", "l AND (a OR b)"]
    at = F.lit(datetime.datetime(2024, 1, 2))
    assert one(spark, answers.search_url("http://s", F.col("t"), 900), t="a b") == "http://s?mode=artlist&format=json&maxrecords=250&query=a+b&timespan=3m"
    assert one(spark, answers.search_url("http://s", F.col("t"), 10, at, at), t="a").endswith("&startdatetime=20240102000000&enddatetime=20240102000000")


def test_main_text(spark):
    html = "<html><head><style>p{}</style><script>var x = '<p>';</script></head><body><nav>Home</nav><p>A first paragraph that is long enough to be kept &amp; read.</p><div>short</div><!-- <p>no</p> --><p>Another   one that is\nlong enough to be kept as well.</p></body>"
    assert one(spark, answers.main_text(F.col("h"), 30), h=html.replace("is\nlong", "is long")).split("\n") == ["A first paragraph that is long enough to be kept & read.", "Another one that is long enough to be kept as well."]
    assert one(spark, answers.main_text(F.col("h")), h="<p>short</p>") == "short" and one(spark, answers.main_text(F.col("h")), h="") == ""


def test_snippets_by_example(spark):
    text = "alpha beta gamma delta epsilon zeta"
    cases = [("gamma", 7, "...beta gamma delta..."), ("GAMMA", 100, text), ("alpha", 6, "alpha beta..."), ("zeta", 9, "...epsilon zeta"), ("nothing", 5, "alpha beta..."), ("nothing", 50, text)]
    for excerpt, reach, wanted in cases:
        assert one(spark, tx.snippet(F.col("t"), F.lit(excerpt), reach), t=text) == wanted
    long = "one two three four five six seven eight"
    assert one(spark, tx.snippet(F.col("t"), F.lit("two three four five six absent"), 1), t=long).startswith("...two three four five six")


def test_snippets_hold_what_they_promise(spark):
    r, reach, rows = random.Random(1), 20, []
    for _ in range(200):
        words = ["".join(r.choice("abC") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 60))]
        at = r.randrange(len(words))
        rows.append((" ".join(words), " ".join(words[at : at + r.randint(1, 8)])))
    for row in spark.createDataFrame(rows, "t string, e string").withColumn("s", tx.snippet(F.col("t"), F.col("e"), reach)).collect():
        body = row.s.removeprefix("...").removesuffix("...")
        places = [i for i in range(len(row.t)) if row.t.startswith(body, i)]
        assert places and row.e.lower() in body.lower() and len(body) <= len(row.e) + 2 * reach
        assert any((i > 0) == row.s.startswith("...") and (i + len(body) < len(row.t)) == row.s.endswith("...") for i in places)


def test_windows_moods_versions_languages(spark):
    assert one(spark, tx.windows_around(F.col("t"), ["Nike"], 2), t="a b c NIKE d e f nike g") == "b c nike d e e f nike g"
    assert one(spark, tx.windows_around(F.col("t"), ["x.y"], 2), t="none") == ""
    assert one(spark, tx.bumped(tx.version(F.col("t")), "minor"), t="v2.3.4") == "v2.4.0"
    profiles = {"en": ("the", "and"), "fr": ("le", "et")}
    assert one(spark, tx.likeliest_language(F.col("t"), profiles), t="le chat et the dog et") == "fr" and one(spark, tx.likeliest_language(F.col("t"), profiles), t="xyz") is None
    assert one(spark, tx.english(F.col("t"), F.lit("fr")), t="short") is True and one(spark, tx.english(F.col("t"), F.lit("fr")), t="x" * 100) is False
    assert one(spark, tx.explained(F.lit("A"), F.array(F.lit("b"), F.lit("c")), F.lit(2), F.array(F.lit("positive"))), t="") == "A: b and c (2 excerpts), sentiment positive."
    assert one(spark, tx.confidence_label(F.col("p")), p=0.59) == "medium"
    with pytest.raises(Exception, match="outside"):
        one(spark, tx.confidence_label(F.col("p")), p=1.2)
