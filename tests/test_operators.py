from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexalloy.functions import text as tx
from lexalloy.operators import dedupe, features, matching
from lexalloy.sources import files


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first().x


def test_brands_are_whole_words_in_vocabulary_order(spark):
    names = ["Nike", "Li-Ning", "On Running", "Puma"]
    assert one(spark, "PUMA and nike; Nikes, li-ning!", tx.mentioned(F.col("t"), names)) == ["Nike", "Li-Ning", "Puma"]
    assert one(spark, None, tx.mentioned(F.col("t"), names)) == []


def test_aliases(spark):
    row = spark.createDataFrame([("Big swoosh and Asics", ["Nike", "Asics", "Fila"])], "t string, e array<string>")
    assert row.select(tx.confirmed(F.col("t"), F.col("e"), {"Nike": ["swoosh"]}).alias("x")).first().x == ["Nike", "Asics"]


def test_scrape_rules_in_order(spark):
    long = "word " * 40
    rows = [("short", "en"), (long + "Subscribe to continue", "fr"), (long, "fr"), (long, "en"), (None, None)]
    got = [r.x.status for r in spark.createDataFrame(rows, "t string, l string").select(tx.scrape_status(F.col("t"), F.col("l")).alias("x")).collect()]
    assert got == ["failed", "skipped", "skipped", "success", "failed"]


def test_cleaning_variants(spark):
    text = "Visit https://a.b/c NOW, mail a@b.co — it's 5x!  A b"
    assert one(spark, text, tx.cleaned(F.col("t"))) == "visit now mail it 5x"
    assert one(spark, text, tx.cleaned(F.col("t"), drop_short=False)) == "visit now mail it s 5x a b"
    assert one(spark, text, tx.cleaned_with_punctuation(F.col("t"))) == "visit now, mail it's 5x! a b"
    assert one(spark, None, tx.cleaned(F.col("t"))) == ""


def test_cutting_and_listing(spark):
    assert one(spark, "aaaa bbbb cccc", tx.cut_at(F.col("t"), 10, " ")) == "aaaa bbbb"
    assert one(spark, "aaaaaaaaaaaaaa", tx.cut_at(F.col("t"), 10, " ")) == "aaaaaaaaaa"
    assert one(spark, "One two. Three f", tx.cut_at(F.col("t"), 9, ".", ending=" [cut]", with_mark=True, keep=0.7)) == "One two. [cut]"
    for items, want in (([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert one(spark, items, tx.listed(F.col("t")), "array<string>") == want


def test_json_and_versions(spark):
    assert one(spark, 'x ```json\n{"a": 1}\n``` y {z}', tx.json_in(F.col("t"))) == '{"a": 1}'
    assert one(spark, 'say {"a": {"b": 2}} ok', tx.json_in(F.col("t"))) == '{"a": {"b": 2}}'
    assert one(spark, "none", tx.json_in(F.col("t"))) is None
    assert one(spark, "{a: [1, 2,], }", tx.json_repaired(F.col("t"))) == '{"a": [1, 2]}'
    assert one(spark, "v2", tx.version(F.col("t"))) == [2, 0, 0] and one(spark, "1.2.3", tx.version(F.col("t"))) == [1, 2, 3] and one(spark, "x", tx.version(F.col("t"))) is None


def test_context_words_and_symbols(spark):
    assert one(spark, "a b c Nike d e f g", tx.words_around(F.col("t"), ["Nike"], 2)) == "b c d e"
    assert one(spark, "hi 😀  there", tx.without_symbols(F.col("t"))) == "hi there"


def test_chunks_keep_offsets():
    paragraph = "Alpha beta gamma delta. " * 12
    text = "\n\n".join([paragraph.strip()] * 5) + "\n\nShort end."
    found = matching.chunk_text(text, target=60, most=90, least=20)
    assert len(found) > 2 and [c[0] for c in found] == list(range(len(found)))
    assert all(0 <= a < b <= len(text) for _, _, a, b, _ in found) and all(x[3] <= y[2] for x, y in zip(found, found[1:], strict=False))
    assert matching.chunk_text(None) == [] and matching.chunk_text("  ") == [] and matching.chunk_text("A b.")[0][1:4] == ("A b.", 0, 4)


def test_chunks_as_a_column(spark):
    rows = spark.createDataFrame([("One two. Three.",), (None,)], "t string").select(matching.chunks(F.col("t")).alias("c")).collect()
    assert rows[0].c[0].text == "One two. Three." and rows[1].c == []


def test_matching_prefers_exact_then_best(spark):
    parts = spark.createDataFrame([(10, 1, 0, "The firm cut emissions by half in 2020.", None), (11, 1, 1, "Workers got better pay.", None)], "chunk_id long, article_id long, chunk_index int, chunk_text string, embedding array<double>")
    quotes = [(1, 1, "better pay", None), (2, 1, "the firm cut emission by half in 2020", None), (3, 1, "zzzz qqqq", None), (4, 2, "no chunks", None)]
    excerpts = spark.createDataFrame(quotes, "excerpt_id long, article_id long, excerpt string, embedding array<double>")
    got = {r.excerpt_id: (r.chunk_id, r.method) for r in matching.matched(excerpts, parts).collect()}
    assert got == {1: (11, "exact"), 2: (10, "fuzzy"), 3: (None, "none"), 4: (None, "none")}


def test_cosine_and_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    got = [(r.query, r.neighbour) for r in matching.nearest(v.filter("id = 1"), v, 2, "id", "v").orderBy("similarity", ascending=False).collect()]
    assert got == [(1, 2), (1, 3)]
    assert one(spark, [1.0], tx.cosine(F.col("t"), F.array(F.lit(1.0), F.lit(2.0))), "array<double>") == 0.0


def test_nearest_in_blocks_equals_one_block(spark):
    v = spark.range(60).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("v"))
    want, got = (sorted(map(tuple, matching.nearest(v.filter("id % 2 = 0"), v, 3, "id", "v", n).collect())) for n in (10_000, 7))
    assert len(want) == 90 and got == want


def test_titles_first_wins(spark):
    rows = [(1, "a", "One"), (2, "a", "Two"), (3, "b", " one "), (4, "c", ""), (5, "d", "")]
    got = {r.o: r.duplicate for r in dedupe.first_of_each(spark.createDataFrame(rows, "o long, article_id string, title string"), "o").collect()}
    assert got == {1: None, 2: "id", 3: "title", 4: None, 5: None}


def test_near_titles_equal_the_sequential_rule(spark):
    titles = ["Brand opens a new store in Paris today", "Brand opens a new store in Paris", "Brand opens new store in Paris today", "Other news", "", "Brand opens a new store in Paris todays", "Other  NEWS", "Completely different headline here"]
    kept, dropped = [], set()
    for i, t in enumerate(" ".join(t.lower().split()) for t in titles):
        if t and any(t == k or SequenceMatcher(None, t, k).ratio() >= 0.9 for k in kept):
            dropped.add(i)
        elif t:
            kept.append(t)
    frame = spark.createDataFrame(list(enumerate(titles)), "o long, title string")
    exact = {r.o for r in dedupe.first_of_each(frame.withColumn("article_id", F.col("o")), "o").filter("duplicate is not null").collect()}
    near = {r.dropped for r in dedupe.greedy(dedupe.near_pairs(frame, "o")).collect()}
    assert exact | near == dropped


def test_prediction_logs_by_file_date(spark, tmp_path):
    for day in ("20240101", "20240102", "20240105"):
        (tmp_path / f"fp_predictions_{day}.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00", "probability": 0.5}\nbroken\n')
    got = files.read_prediction_logs(spark, str(tmp_path), "fp", "2024-01-02", "2024-01-05").filter("probability is not null")
    assert got.count() == 2


def test_upsert_update_replace_cascade(spark):
    stored = spark.createDataFrame([("1", "One"), ("2", "Two")], "article_id string, title string")
    new = spark.createDataFrame([("1", "x"), ("3", " TWO"), ("4", "Four")], "article_id string, title string")
    assert {r.article_id: r.outcome for r in files.inserted_if_absent(new, stored).collect()} == {"1": "duplicate_id", "3": "duplicate_title", "4": "new"}
    assert {tuple(r) for r in files.updated(stored, spark.createDataFrame([("1", None)], "article_id string, title string"), "article_id", ["title"]).collect()} == {("1", None), ("2", "Two")}
    assert files.replaced_children(stored, new.limit(1), "article_id").count() == 2
    a = spark.createDataFrame([(1,), (2,)], "id long")
    c = spark.createDataFrame([(10, 1), (20, 2)], "id long, article_id long")
    e = spark.createDataFrame([(100, 10, 10), (200, 20, 10), (300, 20, 20)], "id long, brand_label_id long, chunk_id long")
    kept = files.cascade(a.filter("id = 1"), a, c, c, e)
    assert {(r.id, r.chunk_id) for r in kept["evidence"].collect()} == {(200, None), (300, 20)} and kept["labels"].count() == 1


def test_json_lines_keep_nulls(spark, tmp_path):
    files.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first().value == '{"a":1,"b":null}'


def test_stream_keeps_first_of_all_history(spark, tmp_path):
    from lexalloy.streaming.incremental import ingest

    schema = "article_id string, title string"
    spark.createDataFrame([("0", "Old")], schema).write.parquet(f"{tmp_path}/table")
    spark.createDataFrame([("0", "x"), ("1", "OLD"), ("2", "New"), ("2", "Newer")], schema).write.parquet(f"{tmp_path}/in")
    ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination(60)
    assert {r.article_id for r in spark.read.parquet(f"{tmp_path}/table").collect()} == {"0", "2"}




def test_what_a_text_is_asked_for_is_made_once(spark):
    """Places of names once a text, not once a word; brands of an article once, not once a rule."""
    from lexalloy.plans import operator_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(filter(" not in plan(operator_queries.fe_07_near(spark, "/root/testdata/sf0.001"))
    assert plan(operator_queries.ra_14_audit(spark, "/root/testdata/sf0.001")).count("[^A-Za-z]+") == 1


def test_vocabulary_goes_on_beyond_terms_that_are_everywhere(spark):
    """The most frequent terms are in all documents and fall out: the vocabulary is made of those behind them."""
    rows = [(i, " ".join([f"all{c}" for c in "abcdefgh"] * 3 + [f"few{'xyz'[i % 3]}", "rare" + "abcdefghijkl"[i]])) for i in range(12)]
    docs = spark.createDataFrame([*rows, (None, "fewx")], "id long, text string")
    got = {(r.id, r.term): r.weight for r in features.weighted_terms(docs, "id", F.split("text", " "), max_df=0.8, max_features=2).collect()}
    assert got == {(i, f"few{'xyz'[i % 3]}"): 1.0 for i in range(12) if i % 3 < 2}
