"""Queries that apply the DataFrame operators to the driver's tables, each over its whole table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as tx
from ..operators import document_vectors, drift, entities, evaluation, explanations, feature_store, features, feed, latent, matching, models, tagger, title_index
from ..sources.files import checkpoint_dir, stored
from .tables import VOCABULARY, on_duckdb, on_spark


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_01_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.mentioned(F.col("text"), VOCABULARY), ",").alias("brands"))


def tx_03_paywall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", tx.has_paywall(F.col("text")).alias("paywall"))


def tx_05_scrape_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", tx.scrape_status(F.col("text"), F.col("lang")).alias("s")).select("doc_id", "s.status", "s.error")


def tx_06_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.cleaned(F.col("text"))).alias("cleaned"))


def tx_12_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture has no blank lines: a line is a paragraph."""
    chunked = _read(spark, sf_dir, "documents").select("doc_id", F.explode(matching.chunks(F.col("text"), paragraph=r"\n")).alias("c"))
    return chunked.select("doc_id", "c.index", "c.char_start", "c.char_end", "c.token_count")


def tx_13_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.words_around(F.col("text"), VOCABULARY, 10)).alias("context"))


def ev_01_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence excerpts against the lines of their article."""
    excerpts = on_spark(spark, sf_dir, "SELECT e.id AS excerpt_id, b.article_id, e.excerpt FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id").withColumn("embedding", F.lit(None).cast("array<double>"))
    parts = on_spark(spark, sf_dir, "SELECT id AS chunk_id, article_id, chunk_index, chunk_text FROM [article_chunks] c").withColumn("embedding", F.lit(None).cast("array<double>"))
    return matching.matched(excerpts, parts).withColumn("similarity", F.round("similarity", 6))


def ev_07_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 20."""
    vectors = _read(spark, sf_dir, "embeddings")
    return matching.nearest(vectors.filter("vec_id % 20 = 0"), vectors, 10, "vec_id", "embedding").select("query", "neighbour", F.round("similarity", 5).alias("similarity"))


def fe_01_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tf_idf(_read(spark, sf_dir, "documents"), "doc_id", "text", max_features=2_000).withColumn("weight", F.round("weight", 6))


def fe_08_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", features.proximity(F.col("text"), VOCABULARY[:2], VOCABULARY[2:]).alias("p")).select("doc_id", "p.*")


def fe_12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [features.Rule("shouting", (r"!!",), 2.0), features.Rule("table", (r" \| ", r"\|\w"), 1.5), features.Rule("license", ("licensed under", "all rights", "copyright"), 1.0), features.Rule("brand_event", ("the",), -2.0, brand=VOCABULARY[0])]
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in features.rule_flags(F.col("text"), rules).items()])


def ml_01_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified(_read(spark, sf_dir, "labels"), "quality", "doc_id").groupBy("quality", "split").agg(F.count("*").alias("n"))


def ml_06_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = on_spark(spark, sf_dir, "SELECT round(probability, 6) AS s, article_id % 3 = 0 AS y FROM [classifier_predictions] p").withColumn("y", F.col("y").cast("int"))
    found = evaluation.metrics(scored, "s", "y", 0.2)
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def ev_04_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    excerpts = on_spark(spark, sf_dir, "SELECT e.id AS excerpt_id, b.article_id, e.excerpt FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id")
    return matching.exact_matches(excerpts, on_spark(spark, sf_dir, "SELECT id AS chunk_id, article_id, chunk_index, chunk_text FROM [article_chunks] c"))


#: Patterns that show that a name of the invented prose means something else.
AUDIT = (feed.AuditRule(VOCABULARY[0], r"\|", "table"), feed.AuditRule(VOCABULARY[0], "!!", "shouting"), feed.AuditRule(VOCABULARY[1], "licensed", "license"), feed.AuditRule(VOCABULARY[2], "the and", "phrase"))
CATEGORIES = ("environmental", "social", "governance", "digital_transformation")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spark(spark, sf_dir, "SELECT * FROM [articles] t").withColumn("brands_mentioned", F.expr("filter(split(brands_mentioned, ','), x -> x <> '')"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled articles: a feed of any length, newest first."""
    articles = on_spark(spark, sf_dir, "SELECT id, title, url, source_name, published_at FROM [articles] t WHERE labeling_status = 'labeled'")
    return feed.feed_items(articles, on_spark(spark, sf_dir, "SELECT * FROM [brand_labels] b"), on_spark(spark, sf_dir, "SELECT * FROM [label_evidence] e"), on_spark(spark, sf_dir, "SELECT id, chunk_text FROM [article_chunks] c"), CATEGORIES)


def ra_14_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.audited(_articles(spark, sf_dir), AUDIT).select("id", "audit_brand", "audit_pattern", "audit_reason")


def ra_18_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _feed(spark, sf_dir)
    evidence = F.flatten(F.transform("labels", lambda x: F.transform(x.evidence, lambda e: F.concat_ws(":", x.brand, x.category, F.coalesce(x.sentiment, F.lit("-")), e.confidence, e.excerpt))))
    return items.select("id", "title", F.array_join("brands", ",").alias("brands"), F.array_join("categories", ",").alias("categories"), F.size("labels").cast("long").alias("n_labels"), F.size(evidence).cast("long").alias("n_evidence"), F.md5(F.array_join(F.sort_array(evidence), "\n")).alias("evidence_md5"))


def ra_20_feed_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.feed_tops(_feed(spark, sf_dir), "brands")


def tx_15_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet of each document around each benchmark item's first five words, wherever an item occurs."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    held = on_spark(spark, sf_dir, registry_text("ev_exact")).join(items, "item_id").join(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return held.select("item_id", "doc_id", tx.snippet(F.col("text"), F.array_join(F.slice(F.split(F.trim("item"), " "), 1, 5), " "), 60).alias("snippet"))


def registry_text(name: str) -> str:
    from . import registry
    from .tables import SPARK

    return registry.text(name, SPARK)


def tx_18_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest words of three letters or more by class."""
    words = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("quality", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return features.top_words(words.filter(F.length("word") >= 3), "quality", STOP, 10)


STOP = ("the", "and", "for", "that", "with", "der", "die", "und", "que", "les")


def io_12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", answers.main_text(F.col("html")).alias("main_text"))


def sc_36_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _read(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.struct("user_id", F.from_json("props", "k int").alias("props")).alias("who")).alias("e"))
    return answers.flattened(nested).select("event_id", F.col("`e.event_type`").alias("event_type"), F.col("`e.who.user_id`").alias("user_id"), F.col("`e.who.props.k`").alias("k"))


def sc_28_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired JSON of a text that a model might have written around it."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.replace(F.col("props"), F.lit("}"), F.lit(",}")), F.lit("\n```\n"))
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object(tx.json_repaired(tx.json_in(wrapped)), "$.k").alias("k"))


def ra_21_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source and distinct long words as search strings of at most 100 characters."""
    terms = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 12)))
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(answers.packed_terms(terms, 100)).alias("query"))


def fe_07_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = features.vocabulary_near(F.col("text"), VOCABULARY[:2], {"common": ("the", "of", "and"), "brands": VOCABULARY[2:]})
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in near.items()])


def fe_16_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.metadata(F.col("source"), F.array("lang"), {"first": ("src1",), "late": ("src7", "src8", "src9")}, {"english": ("EN",), "other": ("fr", "de", "es")})
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()])


def fe_18_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.substring_vocabulary(F.col("text"), {"common": ("the ", "tion", "ing "), "brands": VOCABULARY}, ("!!", " | "))
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()])


def fe_25_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.headline(F.split("text", "\n")[0], {"question": (r"\?$", "^who"), "number": (r"[0-9]", "percent"), "loud": ("!!", r"[A-Z]{6}")})
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()])


def fe_02_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies and weights' sums of character n-grams of titles."""
    titles = on_spark(spark, sf_dir, "SELECT id, title FROM [articles] t")
    weights = features.weighted_terms(titles, "id", features.characters(F.col("title")), max_features=5_000)
    return weights.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _statistics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, models.Scorer]:
    """A few statistics of each document's text as features, and a forest trained on the labelled documents."""
    text = F.col("text")
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("chars"), F.size(F.split(text, r"\s+")).alias("words"), F.length(F.regexp_replace(text, r"[^!|#]+", "")).alias("signs"), F.size(F.split(text, "\n")).alias("lines"))
    labelled = stored(rows.join(_read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter("label is not null"), "doc_id", "left"), "statistics")
    blocks, _ = features.assembled_blocks(labelled, {"size": ("chars", "words", "lines"), "signs": ("signs",)}, F.col("label").isNotNull())
    return blocks, models.fitted(blocks.filter("label is not null"), models.Config("forest", (("numTrees", 20), ("seed", 1))))


def ml_19_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group of features adds to the scores of all documents: mean absolute Shapley values, shares, ranks."""
    blocks, scorer = _statistics(spark, sf_dir)
    found = models.group_importance(explanations.attributions(blocks, scorer), {"size": (0, 3), "signs": (3, 4)})
    return found.select("name", F.round("importance", 9).alias("importance"), F.round("share", 9).alias("share"), "rank")


def ml_18_word_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words of each title that a score (by the title's vowels and length) rests on most."""
    titles = on_spark(spark, sf_dir, "SELECT id, title FROM [articles] t")

    def score(rows: DataFrame) -> DataFrame:
        vowels = F.length(F.regexp_replace(F.lower("title"), "[^aeiou]", "")) / F.greatest(F.length("title"), F.lit(1))
        return rows.withColumn("probability", 1 / (1 + F.exp(3 - 10 * vowels + 0.01 * F.length("title"))))

    return explanations.word_importance(titles, score, "id", "title", samples=100, top=5).select("id", "place", "word", F.round("weight", 6).alias("weight"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(features.vectors(features.tf_idf(_read(spark, sf_dir, "documents"), "doc_id", "text", max_features=2_000), "doc_id"), "terms")


def fe_03_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first 16 latent components; by size up to 16, the share of the squares that they hold."""
    rows = _terms(spark, sf_dir)
    found = latent.factorised(rows, 16)
    shares = F.array(*[F.lit(found.explained(k)) for k in (4, 8, 16)])
    return found.apply(rows).select("doc_id", F.transform("latent", lambda x: F.round(x, 5)).alias("latent"), F.transform(shares, lambda x: F.round(x, 6)).alias("explained"))


def ml_09_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many latent components serve a logistic model of quality best: four sizes from one factorisation of all documents."""
    labelled = _terms(spark, sf_dir).join(_read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    found = latent.factorised(labelled, 32)
    rows = stored(found.apply(labelled.filter("label IS NOT NULL")).select("doc_id", "label", "latent"), "labelled_latent")
    return latent.swept(rows, found, (4, 8, 16, 32), models.Config("logistic", (("maxIter", 10),)), folds=2)


def fe_05_document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph vectors of all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    settings = document_vectors.Settings(size=16, window=2, negatives=3, passes=1, frozen_passes=4)
    model = document_vectors.trained(docs, "doc_id", settings=settings, epochs=2, max_words=5_000)
    return model.vectors(docs).select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def ra_12_near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles against all before them, in three batches against a stored index."""
    titles = stored(on_spark(spark, sf_dir, "SELECT id, title FROM [articles] t"), "titles")
    first, last = titles.agg(F.min("id"), F.max("id")).first()
    index = title_index.TitleIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/titles-{uuid.uuid4().hex}")
    cuts = [first + (last - first + 1) * i // 3 for i in range(4)] if first is not None else [0, 0]
    parts = [index.add(titles.filter((F.col("id") >= a) & (F.col("id") < b)), "id") for a, b in zip(cuts, cuts[1:], strict=False)]
    return reduce(DataFrame.unionByName, parts)


def fe_28_stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of all texts by way of a feature store: computed once a distinct text, then only read."""
    store = feature_store.FeatureStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}")
    docs, config = _read(spark, sf_dir, "documents").select("doc_id", "text"), {"feature": "lengths"}
    compute = lambda rows: rows.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.size(F.split("text", "\n")).cast("long")})
    store.features(docs, config, compute)
    found, asked = store.features(docs, config, compute)
    return found.select("doc_id", "n_chars", "n_lines", F.lit(asked).cast("long").alias("asked_again"))


def mo_03_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the predictions since the middle of January against those before, and the table's verdict."""
    rows = on_spark(spark, sf_dir, "SELECT round(probability, 6) AS probability, article_id, prediction, classifier_type, created_at FROM [classifier_predictions] p")
    late = F.col("created_at") >= F.lit("2024-01-15").cast("timestamp")
    found = drift.report(rows.filter(~late), rows.filter(late), ("probability", "article_id"), ("classifier_type", "prediction"))
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def ml_11_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a forest on a few statistics of its text, trained on the labelled ones."""
    blocks, scorer = _statistics(spark, sf_dir)
    return scorer.score(blocks).select("doc_id", F.round("probability", 6).alias("probability"), "predicted")


#: What a wording of the invented prose stands for: entities by a word before them or by their form, parts of speech by endings.
_ENTITIES = (tagger.Seed("PERCENT", r"\d+(?:\.\d+)?\s?%"), tagger.Seed("MONEY", r"[$€£]\s?\d[\d.,]*"), tagger.Seed("DATE", r"\b(?:19|20)\d\d\b"), tagger.Seed("GPE", r"(?<=\bin )\w+"), tagger.Seed("PERSON", r"(?<=\bby )\w+(?: \w+)?"), tagger.Seed("ORG", r"\b[A-Z]\w*(?:tion|ment|keit|ing)\b"))
_SPEECH = (tagger.Seed("VBG", r"\b\w+ing\b"), tagger.Seed("VBD", r"\b\w+ed\b"), tagger.Seed("NN", r"\b\w+(?:tion|ment|keit|ción)\b"), tagger.Seed("JJ", r"\b\w+(?:al|ive|ous|lich)\b"))


def _tagger(docs: DataFrame, seeds: tuple[tagger.Seed, ...], spans: bool) -> tagger.Tagger:
    """Counted from all documents."""
    return tagger.fitted_by_seeds(docs, "text", seeds, spans, "O" if spans else "XX")


def _with_entities(docs: DataFrame, names) -> DataFrame:
    found = _tagger(docs, _ENTITIES, True).plugin("entities").column(F.col("text"))
    return docs.withColumn("names", names).withColumn("found", found).withColumn("found", entities.near_names(F.col("text"), F.col("names"), F.col("found")))


def fe_13_entity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities near names, names that are also something else, and entities of whole texts, for all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    e = F.col("found")
    blocks = entities.near_block(e, ("PERSON", "GPE", "DATE"), ("ORG", "MONEY", "PERCENT"), {"has_person": ("PERSON",), "has_place": ("GPE",), "has_org": ("ORG",)})
    blocks |= entities.collision_block(F.col("text"), F.col("names"), e, VOCABULARY[:2], (VOCABULARY[2][:5],), VOCABULARY[3:4]) | entities.document_block(e)
    return _with_entities(docs, tx.mentioned(F.col("text"), VOCABULARY)).select("doc_id", *[c.alias(k) for k, c in blocks.items()])


def fe_15_speech_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    names = tx.mentioned(F.col("text"), VOCABULARY)
    words = _tagger(docs, _SPEECH, False).plugin("tokens").column(F.when(F.size(names) > 0, F.col("text")))  # without names all counts are 0, whatever the tags
    return docs.select("doc_id", entities.speech_block(words, names).alias("s")).select("doc_id", "s.*")


def sd_05_entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities near names that stand anywhere in the text, by the label of quality."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return entities.label_report(_with_entities(docs, entities.contained(F.col("text"), VOCABULARY)), "quality", "found")


QUERIES = {f.__name__: f for f in (tx_01_brands, tx_03_paywall, tx_05_scrape_status, tx_06_cleaned, tx_12_chunks, tx_13_context, ev_01_matched, ev_04_exact, ev_07_nearest, fe_01_tf_idf, fe_02_characters, fe_03_latent, fe_05_document_vectors, fe_07_near, fe_08_proximity, fe_12_rules, fe_13_entity_blocks, fe_15_speech_block, fe_16_metadata, fe_18_vocabulary, fe_25_headline, fe_28_stored_features, io_12_main_text, ml_01_split, ml_06_metrics, ml_09_tuned, ml_11_scored, ml_18_word_importance, ml_19_attributions, mo_03_drift, ra_12_near_titles, ra_14_audit, ra_18_feed, ra_20_feed_tops, ra_21_packed, sd_05_entity_report, sc_28_props, sc_36_flattened, tx_15_snippets, tx_18_words)}

_PAYWALL = " OR ".join(f"contains(lower(text), '{p}')" for p in tx.PAYWALL)


def _word(name: str) -> str:
    return f"(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]){name}($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])"


def _places(names: tuple[str, ...]) -> str:
    return f"list_filter(range(1, len(w) + 1), lambda i: list_contains({list(names)}, w[i]))"


def _held(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + ")"


_named = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_word(b)}') THEN '{b}' END" for b in VOCABULARY)
_all_names = list(VOCABULARY)
_bare = "SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[.,!?;:''\"()\\[\\]{}]+|[.,!?;:''\"()\\[\\]{}]+$', '', 'g')) AS w FROM documents"
ORACLES = {
    "tx_03_paywall": f"SELECT doc_id, ({_PAYWALL}) AS paywall FROM documents",
    "tx_05_scrape_status": f"SELECT doc_id, CASE WHEN length(trim(text)) < 100 THEN 'failed' WHEN {_PAYWALL} THEN 'skipped' WHEN lang <> 'en' THEN 'skipped' ELSE 'success' END AS status, CASE WHEN length(trim(text)) < 100 THEN 'content too short' WHEN {_PAYWALL} THEN 'paywall' WHEN lang <> 'en' THEN concat('language ', lang) END AS error FROM documents",
    "tx_06_cleaned": r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+', ' ', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1), ' ')) AS cleaned FROM documents""",
    "ev_07_nearest": "SELECT query, neighbour, round(similarity, 5) AS similarity FROM (SELECT q.vec_id AS query, v.vec_id AS neighbour, s.similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.similarity DESC, v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id, LATERAL (SELECT list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS similarity) s) r WHERE k <= 10",
    "fe_28_stored_features": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS asked_again FROM documents",
    "mo_03_drift": on_duckdb("WITH r AS (SELECT round(probability, 6) AS probability, article_id, prediction, classifier_type, CASE WHEN created_at >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END AS side FROM [classifier_predictions] p), "
        "v AS (SELECT 'probability' AS c, CAST(probability AS DOUBLE) AS v, side FROM r UNION ALL SELECT 'article_id', CAST(article_id AS DOUBLE), side FROM r), g AS (SELECT c, v, CAST(sum(1 - side) AS DOUBLE) AS a, CAST(sum(side) AS DOUBLE) AS b FROM v WHERE v IS NOT NULL GROUP BY c, v), "
        "u AS (SELECT c, sum(a) OVER w AS fa, sum(b) OVER w AS fb, sum(a) OVER (PARTITION BY c) AS n, sum(b) OVER (PARTITION BY c) AS m FROM g WINDOW w AS (PARTITION BY c ORDER BY v)), "
        "k AS (SELECT c, 'number' AS kind, max(abs(fa / nullif(n, 0) - fb / nullif(m, 0))) AS s, 1.3581 * sqrt(max((n + m) / nullif(n * m, 0))) AS t FROM u GROUP BY c), "
        "d AS (SELECT 'classifier_type' AS c, CAST(classifier_type AS VARCHAR) AS v, side FROM r UNION ALL SELECT 'prediction', CAST(prediction AS VARCHAR), side FROM r), h AS (SELECT c, v, CAST(sum(1 - side) AS DOUBLE) AS a, CAST(sum(side) AS DOUBLE) AS b FROM d WHERE v IS NOT NULL GROUP BY c, v), "
        "p AS (SELECT c, a, b, sum(a) OVER (PARTITION BY c) / (sum(a) OVER (PARTITION BY c) + sum(b) OVER (PARTITION BY c)) AS p FROM h), x AS (SELECT c, sum((a - (a + b) * p) ** 2 / nullif((a + b) * p, 0) + (b - (a + b) * (1 - p)) ** 2 / nullif((a + b) * (1 - p), 0)) AS chi, count(*) - 1 AS f FROM p GROUP BY c), "
        "q AS (SELECT c, 'category' AS kind, CASE WHEN f > 0 THEN (cbrt(chi / f) - (1 - 2.0 / (9 * f))) / sqrt(2.0 / (9 * f)) ELSE 0 END AS s, 1.6449 AS t FROM x), "
        "z AS (SELECT c, count(v) FILTER (WHERE side = 0) AS n, count(v) FILTER (WHERE side = 1) AS m, count(*) FILTER (WHERE side = 0) AS n_all, count(*) FILTER (WHERE side = 1) AS m_all FROM (SELECT c, CAST(v AS VARCHAR) AS v, side FROM v UNION ALL SELECT c, v, side FROM d) y GROUP BY c), "
        "o AS (SELECT z.c AS \"column\", y.kind, z.n AS n_reference, z.m AS n_current, 1 - z.n / nullif(z.n_all, 0) AS missing_reference, 1 - z.m / nullif(z.m_all, 0) AS missing_current, CASE WHEN z.n > 0 AND z.m > 0 THEN y.s END AS statistic, CASE WHEN z.n > 0 AND z.m > 0 THEN y.t END AS critical, coalesce(z.n > 0 AND z.m > 0 AND y.s > y.t, false) AS drifted, CASE WHEN z.n > 0 AND z.m > 0 THEN 'compared' ELSE 'no values' END AS status FROM z JOIN (SELECT * FROM k UNION ALL SELECT * FROM q) y ON y.c = z.c), "
        "e AS (SELECT * FROM o UNION ALL SELECT '(all)', 'table', max(n_reference), max(n_current), avg(missing_reference), avg(missing_current), count(*) FILTER (WHERE drifted) / nullif(count(*) FILTER (WHERE status = 'compared'), 0), 0.5, coalesce(count(*) FILTER (WHERE drifted) / nullif(count(*) FILTER (WHERE status = 'compared'), 0) >= 0.5, false), CASE WHEN count(*) FILTER (WHERE status = 'compared') > 0 THEN 'compared' ELSE 'no data' END FROM o) "
        "SELECT \"column\", kind, CAST(n_reference AS BIGINT) AS n_reference, CAST(n_current AS BIGINT) AS n_current, round(missing_reference, 9) AS missing_reference, round(missing_current, 9) AS missing_current, round(statistic, 9) AS statistic, round(CAST(critical AS DOUBLE), 9) AS critical, drifted, status FROM e"),
    "ml_01_split": "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), s AS (SELECT quality, unnest([0, 1, 2]) AS split, n FROM n), c AS (SELECT quality, split, ceil(n * 0.6 - 1e-9) AS a, ceil(n * 0.8 - 1e-9) AS b, n FROM s) SELECT quality, split, CAST(CASE split WHEN 0 THEN a WHEN 1 THEN b - a ELSE n - b END AS BIGINT) AS n FROM c WHERE CASE split WHEN 0 THEN a WHEN 1 THEN b - a ELSE n - b END > 0",
    "tx_01_brands": f"SELECT doc_id, concat_ws(',', {_named}) AS brands FROM documents",
    "tx_13_context": f"SELECT doc_id, md5(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_all_names}, w[i]) AND len(list_filter(p, lambda q: abs(q - i) <= 10)) > 0), lambda i: w[i]), ' ')) AS context FROM (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_contains({_all_names}, w[i])) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS w FROM documents) a) b",
    "fe_08_proximity": f"SELECT doc_id, CASE WHEN ok THEN CAST(list_min(d) AS DOUBLE) ELSE 100 END AS min_distance, CASE WHEN ok THEN list_sum(d) / len(a) ELSE 100 END AS mean_distance, CAST(CASE WHEN ok THEN list_sum(list_transform(a, lambda p: len(list_filter(b, lambda q: abs(p - q) <= 15)))) ELSE 0 END AS INT) AS n_near, CASE WHEN ok AND list_min(d) <= 15 THEN 1 ELSE 0 END AS any_near FROM (SELECT *, len(a) > 0 AND len(b) > 0 AS ok, list_transform(a, lambda p: list_min(list_transform(b, lambda q: abs(p - q)))) AS d FROM (SELECT doc_id, {_places(VOCABULARY[:2])} AS a, {_places(VOCABULARY[2:])} AS b FROM ({_bare}) w) x) y",
    "fe_07_near": f"SELECT doc_id, {', '.join(f'CAST(len(list_distinct(list_filter(list_transform(list_filter(c{i}, lambda i: len(list_filter(a, lambda p: abs(p - i) <= 15)) > 0), lambda i: w[i]), lambda x: true))) AS INT) AS n_near_{n}' for i, n in enumerate(('common', 'brands')))} FROM (SELECT doc_id, w, {_places(VOCABULARY[:2])} AS a, {_places(('the', 'of', 'and'))} AS c0, {_places(VOCABULARY[2:])} AS c1 FROM ({_bare}) w) x",
    "fe_12_rules": f"SELECT *, shouting + \"table\" + license AS n_rules, 2.0 * shouting + 1.5 * \"table\" + 1.0 * license - 2.0 * brand_event AS score FROM (SELECT doc_id, CAST(contains(text, '!!') AS INT) AS shouting, CAST(regexp_matches(text, '(?i) \\| |\\|\\w') AS INT) AS \"table\", CAST(regexp_matches(text, '(?i)licensed under|all rights|copyright') AS INT) AS license, CAST(regexp_matches(text, '(?i)the') AND regexp_matches(lower(text), '{_word(VOCABULARY[0])}') AS INT) AS brand_event FROM documents) x",
    "ml_06_metrics": "WITH s AS (SELECT round(least(greatest(value / 200, 0), 1), 6) AS s, CASE WHEN (event_id % 1000) % 3 = 0 THEN 1 ELSE 0 END AS y FROM events), n AS (SELECT sum(CASE WHEN s >= 0.2 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.2 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN s < 0.2 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN s < 0.2 AND y = 0 THEN 1 ELSE 0 END) AS tn FROM s), g AS (SELECT s, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM s GROUP BY s), c AS (SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), a AS (SELECT sum(n * (tp - p / 2)) / max(ps * ns) AS roc_auc, sum(p / ps * tp / (tp + fp)) AS average_precision FROM c) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fn + fp), 9) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 9) AS f_beta FROM n, a",
    "ev_04_exact": on_duckdb("SELECT e.id AS excerpt_id, arg_min(c.id, c.chunk_index) AS chunk_id FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id JOIN [article_chunks] c ON c.article_id = b.article_id AND contains(c.chunk_text, trim(e.excerpt, ' \t\n\r')) GROUP BY e.id"),
    "ra_14_audit": on_duckdb("SELECT id, brand AS audit_brand, pattern AS audit_pattern, reason AS audit_reason FROM (SELECT a.id, r.*, row_number() OVER (PARTITION BY a.id ORDER BY r.k) AS place FROM [articles] a JOIN (VALUES " + ", ".join(f"({i}, '{r.brand}', '{r.pattern}', '{r.reason}')" for i, r in enumerate(AUDIT)) + ") r(k, brand, pattern, reason) ON contains(',' || a.brands_mentioned || ',', ',' || r.brand || ',') AND regexp_matches(concat_ws(chr(10), a.title, left(a.full_content, 2000)), '(?i)' || r.pattern)) x WHERE place = 1"),
    "ra_18_feed": on_duckdb(f"WITH s AS (SELECT b.id, b.article_id, b.brand, c.category, CASE c.category {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN b.{c}' for c in CATEGORIES)} END AS applies, CASE c.category {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN b.{c.split(chr(95))[0]}_sentiment' for c in CATEGORIES)} END AS mood FROM [brand_labels] b, (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CATEGORIES)}) c(category)), l AS (SELECT * FROM s WHERE applies), "
        "e AS (SELECT l.article_id, concat_ws(':', l.brand, l.category, coalesce(CASE l.mood WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END, '-'), CASE WHEN e.relevance_score >= 0.85 THEN 'high' WHEN e.relevance_score >= 0.7 THEN 'medium' WHEN e.relevance_score >= 0.5 THEN 'low' ELSE 'unmatched' END, e.excerpt) AS line FROM l JOIN [label_evidence] e ON e.brand_label_id = l.id AND split_part(e.category, '_', 1) = split_part(l.category, '_', 1)), "
        "n AS (SELECT article_id, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n_labels FROM l GROUP BY article_id), m AS (SELECT article_id, count(*) AS n_evidence, md5(string_agg(line, chr(10) ORDER BY line)) AS evidence_md5 FROM e GROUP BY article_id) "
        "SELECT a.id, a.title, coalesce(n.brands, '') AS brands, coalesce(n.categories, '') AS categories, coalesce(n.n_labels, 0) AS n_labels, coalesce(m.n_evidence, 0) AS n_evidence, coalesce(m.evidence_md5, md5('')) AS evidence_md5 FROM [articles] a LEFT JOIN n ON n.article_id = a.id LEFT JOIN m ON m.article_id = a.id WHERE a.labeling_status = 'labeled'"),
    "ra_20_feed_tops": on_duckdb("SELECT brand AS name, count(DISTINCT a.id) AS n FROM [articles] a JOIN [brand_labels] b ON b.article_id = a.id WHERE a.labeling_status = 'labeled' AND (environmental OR social OR governance OR digital_transformation) GROUP BY brand ORDER BY n DESC, name LIMIT 10"),
    "tx_18_words": f"SELECT quality, word, n FROM (SELECT quality, word, count(*) AS n, row_number() OVER (PARTITION BY quality ORDER BY count(*) DESC, word) AS k FROM (SELECT l.quality, unnest(regexp_extract_all(lower(d.text), '[a-z]+')) AS word FROM documents d JOIN labels l USING (doc_id)) x WHERE length(word) >= 3 AND word NOT IN {STOP} GROUP BY quality, word) y WHERE k <= 10",
    "sc_36_flattened": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k FROM events",
    "sc_28_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "fe_16_metadata": "SELECT doc_id, CAST(contains(lower(source), 'src1') AS INT) AS from_first, CAST(contains(lower(source), 'src7') OR contains(lower(source), 'src8') OR contains(lower(source), 'src9') AS INT) AS from_late, CAST(lang = 'en' AS INT) AS topic_english, CAST(lang IN ('fr', 'de', 'es') AS INT) AS topic_other, 1 AS n_categories, 1 AS has_categories FROM documents",
    "fe_18_vocabulary": f"SELECT doc_id, n_common, n_brands, CAST(n_common > 0 AS INT) AS has_common, CAST(n_brands > 0 AS INT) AS has_brands, n_common + n_brands AS n_total, n_other, CASE WHEN n_common + n_brands + n_other > 0 THEN (n_common + n_brands) / (n_common + n_brands + n_other) ELSE 0.5 END AS share FROM (SELECT doc_id, {_held(('the ', 'tion', 'ing '))} AS n_common, {_held(VOCABULARY)} AS n_brands, {_held(('!!', ' | '))} AS n_other FROM documents) x",
    "fe_25_headline": "SELECT doc_id, n_question, n_number, n_loud, CAST(n_question > 0 AS INT) AS is_question, CAST(n_number > 0 AS INT) AS is_number, CAST(n_loud > 0 AS INT) AS is_loud FROM (SELECT doc_id, CAST(regexp_matches(t, '\\?$') AS INT) + CAST(regexp_matches(t, '(?i)^who') AS INT) AS n_question, CAST(regexp_matches(t, '[0-9]') AS INT) + CAST(regexp_matches(t, '(?i)percent') AS INT) AS n_number, CAST(regexp_matches(t, '!!') AS INT) + CAST(regexp_matches(t, '(?i)[A-Z]{6}') AS INT) AS n_loud FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents) x) y",
}
