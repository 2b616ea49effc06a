"""The news tables as views over the driver's tables: one definition for each of Spark and DuckDB, the same rows in both.

A view is named in a statement as ``[name]``; only the views that a statement names are built. Spark plans each as part
of the one statement, so filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Words of the invented prose that stand for brands.
VOCABULARY = ("thatin", "ononst", "inoran", "orantion", "hehely")


@dataclass(frozen=True)
class Dialect:
    """What Spark and DuckDB spell differently."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def words_only(self, text: str) -> str:
        more = "" if self.spark else ", 'g'"
        return f"concat(' ', lower(regexp_replace({text}, '[^A-Za-z]+', ' '{more})), ' ')"

    def first_line(self, text: str) -> str:
        return f"split_part({text}, '\n', 1)"

    def lines(self, text: str, table: str) -> str:
        """FROM item: a row (pos from 0, line) for each line of a text."""
        if self.spark:
            return f"{table} LATERAL VIEW posexplode(split({text}, '\n')) AS pos, line"
        return f"(SELECT *, unnest(range(len(string_split({text}, '\n')))) AS pos, unnest(string_split({text}, '\n')) AS line FROM {table})"

    def plus_days(self, base: str, days: str) -> str:
        return f"({base} + make_interval(0, 0, 0, {days}))" if self.spark else f"({base} + to_days(CAST({days} AS INTEGER)))"

    def timestamp(self, value: str) -> str:
        return f"TIMESTAMP_NTZ '{value}'" if self.spark else f"TIMESTAMP '{value}'"

    def seconds(self, start: str, end: str) -> str:
        return f"timestampdiff(SECOND, {start}, {end})" if self.spark else f"date_sub('second', {start}, {end})"

    def local(self, ts: str) -> str:
        """Wall-clock time in Los Angeles. The tables' instants lie in winter, for which DuckDB (no time zones here) is given the offset."""
        return f"CAST(from_utc_timestamp(CAST({ts} AS TIMESTAMP), 'America/Los_Angeles') AS TIMESTAMP_NTZ)" if self.spark else f"({ts} - INTERVAL 8 HOUR)"

    def clock(self, ts: str) -> str:
        return f"date_format({ts}, 'HH:mm:ss')" if self.spark else f"strftime({ts}, '%H:%M:%S')"

    def days(self, start: str, end: str) -> str:
        """A set of dates from start to end as a column."""
        return f"explode(sequence({start}, {end}, INTERVAL 1 DAY))" if self.spark else f"CAST(unnest(generate_series({start}, {end}, INTERVAL 1 DAY)) AS DATE)"

    def view(self, name: str) -> str:
        return VIEWS[name](self)


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _articles(d: Dialect) -> str:
    hits = ", ".join(f"CASE WHEN contains(w, ' {b} ') THEN '{b}' END" for b in VOCABULARY)
    count = " + ".join(f"CASE WHEN contains(w, ' {b} ') THEN 1 ELSE 0 END" for b in VOCABULARY)
    day = "CASE t.doc_id % 60 WHEN 17 THEN 18 WHEN 41 THEN 42 ELSE t.doc_id % 60 END"
    created = d.plus_days(d.timestamp("2024-01-01 06:00:00"), f"CAST({day} AS INT)")
    return f"""SELECT x.*, nullif(n_brands_or_0, 0) AS n_brands, CASE WHEN labeling_status = 'labeled' THEN {d.plus_days('created_at', '1')} END AS labeled_at,
  {d.plus_days('created_at', '-CAST(id % 7 AS INT)')} AS published_at FROM (
    SELECT t.doc_id AS id, left({d.first_line('t.text')}, 80) AS title, t.text AS full_content, concat('https://', t.source, '.example.com/', t.doc_id) AS url, t.source AS source_name, t.lang AS language,
      CASE WHEN length(t.text) < 100 THEN 'failed' WHEN t.lang <> 'en' THEN 'skipped' WHEN t.doc_id % 10 = 0 THEN 'pending' ELSE 'success' END AS scrape_status,
      CASE WHEN length(t.text) < 100 THEN 'content too short' WHEN t.lang <> 'en' THEN concat('language ', t.lang) END AS scrape_error,
      concat_ws(',', {hits}) AS brands_mentioned, CAST({count} AS BIGINT) AS n_brands_or_0,
      CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'false_positive' WHEN l.quality = 1 THEN 'labeled' WHEN t.doc_id % 2 = 0 THEN 'skipped' ELSE 'failed' END AS labeling_status,
      CASE WHEN l.quality = 0 THEN 'Insufficient content' END AS labeling_error, {created} AS created_at
    FROM (SELECT *, {d.words_only('text')} AS w FROM {{documents}}) t LEFT JOIN {{labels}} l ON l.doc_id = t.doc_id) x"""


def _article_brands(d: Dialect) -> str:
    if d.spark:  # from the array of an article's own brands: no join
        names = ", ".join(f"'{b}'" for b in VOCABULARY)
        return f"SELECT id, created_at, labeled_at, labeling_status, CAST(array_position(array({names}), brand) - 1 AS INT) AS place, brand FROM ({_articles(d)}) a LATERAL VIEW explode(split(nullif(brands_mentioned, ''), ',')) AS brand"
    rows = " UNION ALL ".join(f"SELECT {i} AS place, '{b}' AS brand" for i, b in enumerate(VOCABULARY))
    return f"SELECT a.id, a.created_at, a.labeled_at, a.labeling_status, v.place, v.brand FROM ({_articles(d)}) a JOIN ({rows}) v ON contains(concat(',', a.brands_mentioned, ','), concat(',', v.brand, ','))"


def _brand_labels(d: Dialect) -> str:
    flags = {"environmental": 2, "social": 3, "governance": 5, "digital_transformation": 7}
    flag = ", ".join(f"id % {k} = 0 AS {n}" for n, k in flags.items())
    mood = ", ".join(f"CASE WHEN id % {k} = 0 THEN id % 3 - 1 END AS {n.split('_')[0]}_sentiment" for n, k in flags.items())
    return f"SELECT id * 100 + place AS id, id AS article_id, brand, {flag}, {mood}, CAST(id % 100 AS DOUBLE) / 100 AS confidence_score, {d.plus_days('created_at', '1')} AS labeled_at FROM ({_article_brands(d)}) WHERE labeling_status IN ('labeled', 'failed')"


def _article_chunks(d: Dialect) -> str:
    words = "CAST(length(line) - length(replace(line, ' ', '')) + 1 AS BIGINT)"
    return f"SELECT doc_id * 10000 + pos AS id, doc_id AS article_id, CAST(pos AS BIGINT) AS chunk_index, line AS chunk_text, {words} AS token_count, pos % 3 <> 0 AS has_embedding FROM {d.lines('text', '{documents}')}"


def _label_evidence(d: Dialect) -> str:
    parts = [f"SELECT b.id * 10 + {i} AS id, b.id AS brand_label_id, b.article_id, '{c}' AS category FROM ({_brand_labels(d)}) b WHERE b.{f}" for i, (c, f) in enumerate({"environmental": "environmental", "social": "social", "governance": "governance", "digital": "digital_transformation"}.items())]
    score = "CAST((e.id * 7) % 21 AS DOUBLE) / 20"
    return f"SELECT e.id, e.brand_label_id, e.category, left(t.text, 60) AS excerpt, {score} AS relevance_score, CASE WHEN {score} > 0.3 THEN e.article_id * 10000 END AS chunk_id FROM ({' UNION ALL '.join(parts)}) e JOIN {{documents}} t ON t.doc_id = e.article_id"


def _collection_runs(d: Dialect) -> str:
    n = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT min(event_id) AS id, min(ts) AS started_at, CASE WHEN event_type = 'click' THEN NULL ELSE max(ts) END AS completed_at, CASE WHEN min(event_id) % 3 = 0 THEN 'partial' WHEN min(event_id) % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN min(event_id) % 7 = 0 THEN 'timeout' END AS error_message, count(*) AS api_calls_made, {n('value >= 20')} AS articles_fetched, {n('value < 20')} AS articles_duplicates, {n('value >= 50')} AS articles_scraped, {n('value >= 20 AND value < 50')} AS articles_scrape_failed
  FROM {{events}} GROUP BY CAST(ts AS DATE), event_type"""


def _labeling_runs(d: Dialect) -> str:
    """A run a week; the last one is open."""
    start = d.plus_days(d.timestamp("2024-01-01 00:00:00"), "CAST(7 * week AS INT)")
    end = d.plus_days(d.timestamp("2024-01-01 00:00:00"), "CAST(7 * week + 6 AS INT)")
    return f"""SELECT week AS id, {start} AS started_at, CASE WHEN week < 4 THEN {end} END AS completed_at, CASE WHEN week % 3 = 1 THEN 'partial' ELSE 'success' END AS status, articles_processed, brands_labeled, llm_calls_made, total_input_tokens, total_output_tokens,
  CAST(total_input_tokens AS DOUBLE) / 1000000 * 3 + CAST(total_output_tokens AS DOUBLE) / 1000000 * 15 AS estimated_cost_usd
  FROM (SELECT CAST(floor((extract(DAY FROM ts) - 1) / 7) AS INT) AS week, CASE WHEN floor((extract(DAY FROM ts) - 1) / 7) = 3 THEN 0 ELSE count(DISTINCT user_id) END AS articles_processed, count(*) AS brands_labeled, count(*) * 2 AS llm_calls_made,
    CAST(sum(user_id) AS BIGINT) AS total_input_tokens, CAST(sum(event_id % 500) AS BIGINT) AS total_output_tokens FROM {{events}} GROUP BY floor((extract(DAY FROM ts) - 1) / 7)) w"""


def _predictions(d: Dialect) -> str:
    return "SELECT event_id AS id, event_id % 1000 AS article_id, CASE event_id % 3 WHEN 0 THEN 'fp' WHEN 1 THEN 'ep' ELSE 'esg' END AS classifier_type, least(greatest(value / 200, 0), 1) AS probability, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS prediction, ts AS created_at FROM {events}"


VIEWS = {"articles": _articles, "article_brands": _article_brands, "brand_labels": _brand_labels, "article_chunks": _article_chunks, "label_evidence": _label_evidence, "collection_runs": _collection_runs, "labeling_runs": _labeling_runs, "classifier_predictions": _predictions}
BASE = ("documents", "labels", "events", "benchmark", "embeddings", "pages", "orders", "lineitem", "customer")


def statement(text: str, dialect: Dialect) -> str:
    """text with [view]s in place; base tables stay as {name}."""
    return re.sub(r"\[(\w+)\]", lambda m: f"({dialect.view(m[1])})", text)


def on_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    sql = statement(text, SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def on_duckdb(text: str) -> str:
    return statement(text, DUCK).format(**{t: t for t in BASE})
