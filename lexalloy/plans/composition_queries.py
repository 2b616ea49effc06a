"""Queries over what is put together from several operators: texts from fields, pages, runs, nested evidence, scores of several subjects,
pivots, curves. Each runs over its whole table and has DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assembly, pages
from ..functions import text as tx
from ..operators import evaluation, features, feed, matching, models
from ..sources import runs
from .operator_queries import _held, _named
from .tables import VOCABULARY, on_duckdb, on_spark

AGENTS = ("north", "east", "south", "west", "centre")
#: Subjects, their flags and weights, and the keywords counted for them.
SUBJECTS = {"loud": {"shout": (("!!",), 2.0), "table": ((" | ", "|"), 1.5)}, "legal": {"license": (("licensed under",), 2.0), "rights": (("all rights", "copyright"), 1.5)}}
COUNTED = {"loud": ("!!", " | ", "##"), "legal": ("licensed", "rights", "copyright")}
CURVE = tuple(i / 10 for i in range(1, 10))
COUNTERS = ("articles_fetched", "articles_duplicates", "articles_scraped", "articles_scrape_failed")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_09_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five ways a document's fields become one text, and the prefix alone."""
    text, names = F.col("text"), F.array(*map(F.lit, VOCABULARY))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.array("lang").alias("topics"), F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"))
    docs = docs.withColumn("brands", F.array_intersect(names, tx.mentioned(text, VOCABULARY)))
    fields = [F.col(c) for c in ("title", "text", "brands", "source", "topics")]
    docs, clean = assembly.with_cleaned(docs, *fields[:3])
    made = {"training": assembly.training_text(*fields, clean=clean), "emphasised": assembly.emphasised_text(*fields[:3], clean=clean), "raw": assembly.raw_text(*fields), "labelled": assembly.labelled_text(*fields), "weighted": assembly.weighted_text(*fields, clean=clean)}
    return docs.select("doc_id", assembly.metadata_prefix(F.col("source"), F.col("topics")).alias("prefix"), *[F.md5(c).alias(k) for k, c in made.items()])


def tx_05_brand_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first names of the vocabulary, as many as the id says, which stand in the text; a warning where none does."""
    expected = F.slice(F.array(*map(F.lit, VOCABULARY)), F.lit(1), (F.col("doc_id") % 6).cast("int"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", expected.alias("expected"), F.array_intersect(tx.mentioned(F.col("text"), VOCABULARY), expected).alias("found"))
    return docs.select("doc_id", F.array_join("found", ",").alias("found"), tx.brand_warning(F.col("found"), F.col("expected")).alias("warning"))


def sc_37_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice a document and its own random order of the vocabulary's names that are in it."""
    found = F.transform(tx.mentioned(F.col("text"), VOCABULARY), lambda n: F.concat(n, F.lit("#"), F.col("doc_id")))
    return _read(spark, sf_dir, "documents").select("doc_id", tx.chosen(AGENTS, F.col("doc_id"), 7).alias("agent"), F.array_join(tx.shuffled(found, 7), ",").alias("shuffled"))


def io_12_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages by text density."""
    held = _read(spark, sf_dir, "pages").select("page_id", pages.blocks(F.col("html")).alias("b"))
    return held.select("page_id", "b", pages.main_blocks(F.col("b")).alias("k")).select("page_id", F.size("b").cast("long").alias("n_blocks"), F.size("k").cast("long").alias("n_kept"), F.md5(F.array_join(F.transform("k", lambda b: b.text), "\n")).alias("main_text"))


def io_22_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection runs folded from the rows of their starts and ends, with what they cost."""
    rows = on_spark(spark, sf_dir, "SELECT * FROM [collection_runs] r").withColumn("run_id", F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    parts = {"start": (F.col("started_at"), F.lit("running"), none, F.lit(None).cast("map<string,bigint>")), "end": (F.col("completed_at"), F.col("status"), F.col("error_message"), F.create_map(*[x for c in COUNTERS for x in (F.lit(c), F.col(c).cast("bigint"))]))}
    log = [rows.select("run_id", F.lit("collection").alias("kind"), F.lit(event).alias("event"), at.alias("at"), status.alias("status"), error.alias("error"), none.alias("config"), held.alias("counters")) for event, (at, status, error, held) in parts.items()]
    found = runs.folded(log[0].unionByName(log[1]).filter("at IS NOT NULL"))
    spent = runs.cost(F.col("counters"), {"articles_fetched": 0.002, "articles_scraped": 0.01})
    return found.select("run_id", "status", "error", "seconds", *[F.col("counters")[c].alias(c) for c in COUNTERS], F.round(spent, 6).alias("cost"))


def ev_05_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's evidence by brand and category, with the first chunk that holds it."""
    flags = {"environmental": "environmental", "social": "social", "governance": "governance", "digital": "digital_transformation"}
    labels = on_spark(spark, sf_dir, "SELECT * FROM [brand_labels] b").select("article_id", "brand", F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(v).alias("applies")) for k, v in flags.items()])))
    excerpts = on_spark(spark, sf_dir, "SELECT e.id AS excerpt_id, b.article_id, b.brand, e.category, e.excerpt FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id")
    held = matching.exact_matches(excerpts.select("excerpt_id", "article_id", "excerpt"), on_spark(spark, sf_dir, "SELECT id AS chunk_id, article_id, chunk_index, chunk_text FROM [article_chunks] c"))
    rows = excerpts.join(held.select("excerpt_id", "chunk_id"), "excerpt_id", "left")
    each = matching.nested(labels, rows, columns=("excerpt_id", "chunk_id")).select("article_id", F.explode("brands").alias("brand", "categories"))
    one = lambda m: F.concat_ws("@", m.excerpt_id.cast("string"), F.coalesce(m.chunk_id.cast("string"), F.lit("-")))
    lines = F.transform(F.map_entries("categories"), lambda c: F.concat(c.key, F.lit("="), F.array_join(F.transform(c.value, one), ",")))
    return each.select("article_id", "brand", F.size("categories").cast("long").alias("n_categories"), F.array_join(lines, ";").alias("nested"))


def fe_21_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = features.keyword_scores(F.col("text"), SUBJECTS, COUNTED, VOCABULARY, {"legal": ("license", "rights")})
    return _read(spark, sf_dir, "documents").select("doc_id", scores.alias("s")).select("doc_id", "s.*")


def fe_24_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = features.publisher_block(F.col("source"), F.array("lang", "source"), {"first": ("src1",), "late": ("SRC7", "src8")}, {"english": "EN", "german": "de"}, {"known": ("en", "src1"), "other": ("fr", "es")}, (("src2", 0.9), ("src1", 0.7), ("src3", 0.1)))
    return _read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in block.items()])


def fe_04_window_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights of the words around two names of the vocabulary."""
    return features.window_terms(_read(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY[:2], max_features=500).withColumn("weight", F.round("weight", 6))


def agg_pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prediction of each classifier by day."""
    rows = on_spark(spark, sf_dir, "SELECT id, CAST(created_at AS DATE) AS day, classifier_type, probability, prediction FROM [classifier_predictions] p")
    return evaluation.pivoted(rows, "day", "classifier_type", ("fp", "ep", "esg"), ("probability", "prediction"), F.col("id"))


_FITS = "SELECT id, classifier_type, probability, floor(id / 3) % 3 AS fold, CASE WHEN floor(id / 9) % 4 = 0 THEN 'test' ELSE 'train' END AS part, article_id % 2 AS y FROM [classifier_predictions] p"


def ml_10_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by threshold of each classifier, over folds and parts of all predictions."""
    rows = on_spark(spark, sf_dir, _FITS).select("*", F.explode(F.array(*map(F.lit, CURVE))).alias("threshold"))
    fits = rows.groupBy("classifier_type", "threshold", "fold", "part").agg(F.avg(((F.col("probability") >= F.col("threshold")).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    curve = models.parameter_curve(fits, "threshold", "accuracy", ("classifier_type",))
    return curve.select("classifier_type", "threshold", *[(F.round(c, 9) + 0.0).alias(c) for c in ("mean_train", "std_train", "mean_test", "std_test", "gap", "gain")], "verdict", "is_best", "past_best")


def ml_16_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each classifier's predictions against labels; one classifier's aren't complete."""
    rows = on_spark(spark, sf_dir, "SELECT classifier_type, probability, CASE WHEN classifier_type = 'esg' AND article_id % 7 = 0 THEN NULL ELSE article_id % 2 END AS y FROM [classifier_predictions] p")
    return evaluation.validated(rows, "probability", 0.4, "y", ("classifier_type",)).withColumn("accuracy", F.round("accuracy", 9))


def rm_09_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new cut of the labelled articles would touch, if only chunks with a vector were kept."""
    part = lambda sql: on_spark(spark, sf_dir, sql)
    evidence = part("SELECT b.article_id, e.chunk_id FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id")
    return feed.to_rechunk(part("SELECT id, labeling_status FROM [articles] a"), part("SELECT id, article_id FROM [brand_labels] b"), evidence, part("SELECT id, article_id FROM [article_chunks] c WHERE has_embedding"))


QUERIES = {f.__name__: f for f in (agg_pivot_first, ev_05_nested, fe_04_window_terms, fe_21_scores, fe_24_publishers, io_12_density, io_22_runs, ml_10_curve, ml_16_validation, rm_09_scan, sc_37_choices, tx_05_brand_warning, tx_09_assemblies)}


# DuckDB

def _cleaned(x: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+', ' ', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1), ' ')"


def tf_idf_sql(terms: str, size: int, group: str = "SELECT id, term, round(weight, 6) AS weight FROM w", min_df: int = 2, max_df: float = 0.95) -> str:
    """Weights of terms (id, terms: a list a document). group reads w (id, term, weight)."""
    return (
        f"WITH t AS MATERIALIZED ({terms}), c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM t) x GROUP BY id, term), n AS (SELECT count(*) AS n FROM t), "
        f"k AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT {size}), "
        "u AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM c JOIN k USING (term)), s AS (SELECT id, sqrt(sum(w * w)) AS norm FROM u GROUP BY id), "
        f"w AS (SELECT u.id, term, u.w / norm AS weight FROM u JOIN s USING (id)) {group}"
    )


_names = list(VOCABULARY)
_CONTEXT = f"(SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_names}, w[i]) AND len(list_filter(p, lambda q: abs(q - i) <= 10)) > 0), lambda i: w[i]), ' ') AS near FROM (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_contains({_names}, w[i])) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS w FROM documents) a) b)"
_UNREAD = pages.UNREAD.removeprefix("(?i)")
_decoded = "m"
for _name, _sign in pages.ENTITIES:
    _decoded = f"replace({_decoded}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_plain = "trim(regexp_replace(regexp_replace(b, '[\\x02\\x03\\x04]', '', 'g'), ' +', ' ', 'g'))"


def _around(phrase: str) -> str:
    words = lambda t: f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
    behind, before = words(f"array_to_string(p[i :], '{phrase}')"), words(f"array_to_string(p[: i - 1], '{phrase}')")
    window = f"list_concat(list_concat({before}[-20 :], ['{phrase}']), {behind}[: 20])"
    return f"SELECT doc_id, '{phrase}' AS phrase, flatten(list_transform(range(2, len(p) + 1), lambda i: {window})) AS ws FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), '{phrase}') AS p FROM documents) x"


_flag = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
ORACLES = {
    "tx_09_assemblies": f"SELECT d.doc_id, concat_ws(' ', source, lang) || ' ' AS prefix, md5(concat_ws(' ', source, lang, {_cleaned('title')}, {_cleaned('title')}, {_cleaned('brands')}, {_cleaned('text')})) AS training, "
        f"md5(concat_ws(' ', {_cleaned('title')}, {_cleaned('title')}, {_cleaned('brands')}, {_cleaned('text')}, nullif({_cleaned('near')}, ''))) AS emphasised, md5(concat_ws(' ', source, lang) || ' ' || concat_ws(' ', nullif(title, ''), nullif(text, ''), nullif(brands, ''))) AS raw, "
        f"md5(concat_ws(' ', 'Source ' || source, 'Category ' || lang, nullif(trim(title), ''), nullif(trim(text), ''), nullif(brands, ''))) AS labelled, md5(concat_ws(' ', source, lang, nullif({_cleaned('title')}, ''), nullif({_cleaned('title')}, ''), nullif({_cleaned('brands')}, ''), nullif({_cleaned('text')}, ''))) AS weighted "
        f"FROM (SELECT doc_id, text, source, lang, left(split_part(text, chr(10), 1), 80) AS title, concat_ws(' ', {_named}) AS brands FROM documents) d JOIN {_CONTEXT} c ON c.doc_id = d.doc_id",
    "tx_05_brand_warning": f"SELECT doc_id, array_to_string(found, ',') AS found, CASE WHEN len(expected) > 0 AND len(found) = 0 THEN 'none of the expected names is in the text: ' || array_to_string(expected[: 3], ', ') || CASE WHEN len(expected) > 3 THEN ', ...' ELSE '' END END AS warning "
        f"FROM (SELECT doc_id, expected, list_filter(expected, lambda e: list_contains(string_split(named, ','), e)) AS found FROM (SELECT doc_id, {_names}[: CAST(doc_id % 6 AS INT)] AS expected, concat_ws(',', {_named}) AS named FROM documents) x) y",
    "sc_37_choices": f"SELECT doc_id, {list(AGENTS)}[1 + CAST(('0x' || left(md5('7:' || doc_id), 8)) AS BIGINT) % 5] AS agent, array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(named, ','), lambda x: x <> ''), lambda x: {{'at': CAST(('0x' || left(md5('7:' || x || '#' || doc_id), 8)) AS BIGINT), 'item': x || '#' || doc_id}})), lambda x: x.item), ',') AS shuffled "
        f"FROM (SELECT doc_id, concat_ws(',', {_named}) AS named FROM documents) d",
    "io_12_density": f"WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '[\\x00-\\x20]+', ' ', 'g'), '{_UNREAD}', ' ', 'gi'), '{pages.BLOCK}', chr(10), 'g'), '(?i)<a\\b[^>]*>', chr(2), 'g'), '(?i)</a *>', chr(3), 'g'), '<[^>]*>', chr(4), 'g') AS m FROM pages), "
        f"l AS (SELECT page_id, list_filter(list_transform(string_split({_decoded}, chr(10)), lambda b: {{'t': {_plain}, 'n': length({_plain}), 'k': coalesce(list_sum(list_transform(regexp_extract_all(b, '\\x02([^\\x02\\x03]*)', 1), lambda b: length({_plain}))), 0), 'g': length(regexp_replace(b, '[^\\x02\\x04]+', '', 'g'))}}), lambda b: b.n > 0) AS b FROM a), "
        "d AS (SELECT page_id, b, list_transform(b, lambda x: ln(1 + CAST(greatest(x.n - x.k, 0) AS DOUBLE) / (x.g + 1))) AS d FROM l), s AS (SELECT page_id, b, d, list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i].n * d[i])) / list_sum(list_transform(b, lambda x: x.n)) AS mean FROM d), "
        "k AS (SELECT page_id, b, list_filter(range(1, len(b) + 1), lambda i: (2 * d[i] + CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END + CASE WHEN i < len(b) THEN d[i + 1] ELSE 0 END) / 4 >= 0.5 * mean AND 2 * b[i].k < b[i].n) AS k FROM s) "
        "SELECT page_id, len(b) AS n_blocks, len(k) AS n_kept, md5(array_to_string(list_transform(k, lambda i: b[i].t), chr(10))) AS main_text FROM k",
    "io_22_runs": on_duckdb("SELECT CAST(id AS VARCHAR) AS run_id, CASE WHEN completed_at IS NULL THEN 'running' ELSE status END AS status, CASE WHEN completed_at IS NOT NULL THEN error_message END AS error, CAST(floor(epoch(completed_at)) - floor(epoch(started_at)) AS BIGINT) AS seconds, "
        + ", ".join(f"CASE WHEN completed_at IS NOT NULL THEN {c} END AS {c}" for c in COUNTERS) + ", CASE WHEN completed_at IS NULL THEN 0.0 ELSE round(articles_fetched * CAST(0.002 AS DOUBLE) + articles_scraped * CAST(0.01 AS DOUBLE), 6) END AS cost FROM [collection_runs] r"),
    "ev_05_nested": on_duckdb("WITH x AS (SELECT e.id, b.article_id, b.brand, e.category, arg_min(c.id, c.chunk_index) AS chunk FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id LEFT JOIN [article_chunks] c ON c.article_id = b.article_id AND contains(c.chunk_text, trim(e.excerpt, ' \t\n\r')) GROUP BY e.id, b.article_id, b.brand, e.category), "
        "y AS (SELECT article_id, brand, category, category || '=' || string_agg(id || '@' || coalesce(CAST(chunk AS VARCHAR), '-'), ',' ORDER BY id) AS line FROM x GROUP BY article_id, brand, category) SELECT article_id, brand, count(*) AS n_categories, string_agg(line, ';' ORDER BY category) AS nested FROM y GROUP BY article_id, brand"),
    "fe_21_scores": "SELECT doc_id, " + ", ".join(
        f"CASE WHEN n > 0 THEN n_{g} ELSE 0 END AS n_{g}, CASE WHEN n > 0 THEN 100.0 * n_{g} / n ELSE 0.0 END AS density_{g}, " + ", ".join(f"is_{f}" for f in flags) + ", " + " + ".join(f"CAST({w} AS DOUBLE) * is_{f}" for f, (_, w) in flags.items()) + f" AS score_{g}" for g, flags in SUBJECTS.items())
        + ", greatest(is_license, is_rights) AS any_legal, CAST(2 AS DOUBLE) * is_shout + CAST(1.5 AS DOUBLE) * is_table + CAST(2 AS DOUBLE) * is_license + CAST(1.5 AS DOUBLE) * is_rights AS score, CASE WHEN n > 0 AND n_loud + n_legal + own > 0 THEN own / (n_loud + n_legal + own) ELSE 0.5 END AS own_share FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS n, "
        + ", ".join(f"{_held(words).replace('lower(text)', 't')} AS n_{g}" for g, words in COUNTED.items()) + f", {_held(VOCABULARY).replace('lower(text)', 't')} AS own, " + ", ".join(f"CAST({_flag(words)} AS INT) AS is_{f}" for flags in SUBJECTS.values() for f, (words, _) in flags.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) x) y",
    "fe_24_publishers": "SELECT doc_id, CAST(contains(s, 'src1') AS INT) AS from_first, CAST(contains(s, 'src7') OR contains(s, 'src8') AS INT) AS from_late, CAST(l = 'en' AS INT) AS has_english, CAST(l = 'de' AS INT) AS has_german, CAST(l = 'en' AS INT) + CAST(s = 'src1' AS INT) AS n_known, CAST(l IN ('fr', 'es') AS INT) AS n_other, CAST(CASE WHEN contains(s, 'src2') THEN 0.9 WHEN contains(s, 'src1') THEN 0.7 WHEN contains(s, 'src3') THEN 0.1 ELSE 0.35 END AS DOUBLE) AS reputation FROM (SELECT doc_id, lower(source) AS s, lower(lang) AS l FROM documents) x",
    "fe_04_window_terms": tf_idf_sql("SELECT doc_id AS id, regexp_extract_all(array_to_string(flatten(list(ws ORDER BY place)), ' '), '[a-z]{2,}') AS terms FROM (" + " UNION ALL ".join(f"SELECT doc_id, ws, {i} AS place FROM ({_around(p)}) a{i}" for i, p in enumerate(VOCABULARY[:2])) + ") v GROUP BY doc_id", 500, "SELECT id AS doc_id, term, round(weight, 6) AS weight FROM w"),
    "agg_pivot_first": on_duckdb("SELECT CAST(created_at AS DATE) AS day, " + ", ".join(f"arg_min({v}, id) FILTER (WHERE classifier_type = '{c}') AS {v}_{c}" for v in ("probability", "prediction") for c in ("fp", "ep", "esg")) + " FROM [classifier_predictions] p GROUP BY 1"),
    "ml_10_curve": on_duckdb(f"WITH f AS (SELECT classifier_type, CAST(t AS DOUBLE) AS threshold, fold, part, avg(CASE WHEN CAST(probability >= CAST(t AS DOUBLE) AS INT) = y THEN 1.0 ELSE 0.0 END) AS a FROM ({_FITS}) r, unnest({list(CURVE)}) AS u(t) GROUP BY ALL), "
        "c AS (SELECT classifier_type, threshold, avg(a) FILTER (WHERE part = 'train') AS mean_train, stddev_pop(a) FILTER (WHERE part = 'train') AS std_train, avg(a) FILTER (WHERE part = 'test') AS mean_test, stddev_pop(a) FILTER (WHERE part = 'test') AS std_test FROM f GROUP BY ALL), "
        "g AS (SELECT *, mean_train - mean_test AS gap, mean_test - lag(mean_test) OVER (PARTITION BY classifier_type ORDER BY threshold) AS gain, mean_test IS NOT NULL AND row_number() OVER (PARTITION BY classifier_type ORDER BY round(mean_test, 12) DESC NULLS LAST, threshold) = 1 AS is_best FROM c) "
        "SELECT classifier_type, threshold, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("mean_train", "std_train", "mean_test", "std_test", "gap", "gain")) + ", CASE WHEN gap >= 0.1 THEN 'severe' WHEN gap >= 0.05 THEN 'moderate' ELSE 'good' END AS verdict, is_best, coalesce(bool_or(is_best) OVER (PARTITION BY classifier_type ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past_best FROM g"),
    "ml_16_validation": on_duckdb("SELECT classifier_type, count(*) AS n_samples, CAST(0.4 AS DOUBLE) AS threshold, count(*) FILTER (WHERE probability >= 0.4) AS n_positive, count(*) FILTER (WHERE NOT coalesce(probability BETWEEN 0 AND 1, false)) AS n_invalid, count(*) FILTER (WHERE NOT coalesce(probability BETWEEN 0 AND 1, false)) = 0 AS success, "
        "CASE WHEN count(y) = count(*) THEN round(avg(CASE WHEN CAST(probability >= 0.4 AS INT) = y THEN 1.0 ELSE 0.0 END), 9) END AS accuracy FROM (SELECT classifier_type, probability, CASE WHEN classifier_type = 'esg' AND article_id % 7 = 0 THEN NULL ELSE article_id % 2 END AS y FROM [classifier_predictions] p) s GROUP BY classifier_type"),
    "rm_09_scan": on_duckdb("WITH l AS (SELECT article_id AS id, count(*) AS n FROM [brand_labels] b GROUP BY 1), c AS (SELECT id, article_id FROM [article_chunks] c WHERE has_embedding), k AS (SELECT article_id AS id, count(*) AS n FROM c GROUP BY 1), "
        "e AS (SELECT b.article_id AS id, count(*) AS n, count(*) FILTER (WHERE e.chunk_id IS NOT NULL AND e.chunk_id NOT IN (SELECT id FROM c)) AS d FROM [label_evidence] e JOIN [brand_labels] b ON b.id = e.brand_label_id GROUP BY 1) "
        "SELECT a.id, coalesce(l.n, 0) AS n_labels, coalesce(e.n, 0) AS n_evidence, coalesce(k.n, 0) AS n_chunks, coalesce(e.d, 0) AS n_dangling, coalesce(k.n, 0) = 0 OR coalesce(e.d, 0) > 0 AS needed FROM [articles] a LEFT JOIN l ON l.id = a.id LEFT JOIN e ON e.id = a.id LEFT JOIN k ON k.id = a.id WHERE a.labeling_status = 'labeled'"),
    # the weights of all words and of titles' character sequences
    "fe_01_tf_idf": tf_idf_sql("SELECT doc_id AS id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z][a-zA-Z]+') AS w FROM documents) d", 2_000, "SELECT id AS doc_id, term, round(weight, 6) AS weight FROM w"),
    "fe_02_characters": tf_idf_sql("SELECT doc_id AS id, flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n)))) AS terms FROM (SELECT doc_id, regexp_replace(lower(left(split_part(text, chr(10), 1), 80)), '\\s+', ' ', 'g') AS t FROM documents) d", 5_000, "SELECT term, count(*) AS n, round(sum(weight), 6) AS weight FROM w GROUP BY term"),
}
