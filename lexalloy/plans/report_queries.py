"""Reports and work lists over the news tables, as statements for both engines (see ``news_queries``)."""

from __future__ import annotations

from collections.abc import Callable

from .news_queries import FLAGS, MOOD, percent_if, total_if
from .tables import VOCABULARY, Dialect

QUERIES: dict[str, str | Callable[[Dialect], str]] = {}
ORDERS: dict[str, str] = {}

# work lists and lookups
PENDING = "scrape_status = 'success' AND labeling_status = 'pending' AND full_content IS NOT NULL"
QUERIES["ra_01_queue"] = f"SELECT id, title, created_at FROM [articles] t WHERE {PENDING} ORDER BY created_at, id LIMIT 50"
QUERIES["ra_01_scrape_queue"] = "SELECT id, url, created_at FROM [articles] t WHERE scrape_status = 'pending' ORDER BY created_at, id LIMIT 50"
QUERIES["ra_02_lookup"] = "SELECT id, title, labeling_status FROM [articles] t WHERE id IN (SELECT article_id FROM [brand_labels] b)"
QUERIES["ra_03_children"] = "SELECT article_id, chunk_index, id AS chunk_id, token_count FROM [article_chunks] c"
ORDERS["ra_03_children"] = "article_id, chunk_index"
QUERIES["st_02_cursor"] = "SELECT labeling_status, min(created_at) AS oldest, max(created_at) AS newest, count(*) AS waiting FROM [articles] t WHERE labeling_status IN ('pending', 'failed') GROUP BY labeling_status"

# data sets and audits
QUERIES["ra_10_classes"] = f"SELECT count(*) AS records, {total_if('relevant = 1', 'ones')}, {total_if('relevant = 0', 'zeros')}, CAST(sum(relevant) AS DOUBLE) / nullif(sum(1 - relevant), 0) AS ratio FROM (SELECT CASE labeling_status WHEN 'false_positive' THEN 0 ELSE 1 END AS relevant FROM [articles] t WHERE labeling_status IN ('labeled', 'skipped', 'false_positive')) x"
SEEN = "SELECT id, n_brands, row_number() OVER (PARTITION BY id ORDER BY created_at) AS of_id, row_number() OVER (PARTITION BY CASE WHEN trim(title) = '' THEN concat('#', id) ELSE lower(trim(title)) END ORDER BY created_at, id) AS of_title FROM [articles] t"
QUERIES["ra_11_counters"] = f"SELECT count(*) AS fetched, {total_if('of_id > 1', 'duplicate_ids')}, {total_if('of_id = 1 AND of_title > 1', 'duplicate_titles')}, {total_if('of_id = 1 AND of_title = 1 AND n_brands IS NULL', 'without_brand')}, {total_if('of_id = 1 AND of_title = 1 AND n_brands > 0', 'kept')} FROM ({SEEN}) s"
QUERIES["ra_13_prefilter"] = lambda d: "SELECT article_id, id, probability >= 0.5 AS passes, concat(CASE WHEN probability >= 0.5 THEN 'passed: probability ' ELSE 'below threshold: probability ' END, " + ("format_string('%.3f', probability)" if d.spark else "printf('%.3f', probability)") + ") AS reason FROM (SELECT id, article_id, CAST(floor(probability * 1000) AS DOUBLE) / 1000 AS probability FROM [classifier_predictions] p) x"
QUERIES["ra_15_languages"] = "SELECT language, count(*) AS n FROM [articles] t WHERE length(full_content) >= 100 AND language <> 'en' GROUP BY language"
ORDERS["ra_15_languages"] = "n DESC, language"
FOUND = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(left(full_content, 400)), '{b}') THEN '{b}' END" for b in VOCABULARY) + ")"
QUERIES["ra_16_rebranded"] = f"SELECT id, brands_mentioned AS before, found AS after, found = '' AS goes FROM (SELECT id, brands_mentioned, {FOUND} AS found FROM [articles] t WHERE labeling_status <> 'labeled') x WHERE found <> brands_mentioned"
QUERIES["ra_20_categories"] = "SELECT category, count(DISTINCT article_id) AS articles FROM (SELECT article_id, " + "CASE f.k " + " ".join(f"WHEN {i} THEN CASE WHEN {f} THEN '{f}' END" for i, f in enumerate(FLAGS)) + " END AS category FROM [brand_labels] b CROSS JOIN (VALUES " + ", ".join(f"({i})" for i in range(len(FLAGS))) + ") f(k)) s WHERE category IS NOT NULL GROUP BY category ORDER BY articles DESC, category LIMIT 10"

# collecting: time windows, totals, cost
QUERIES["ra_23_weeks"] = lambda d: (
    "WITH ends AS (SELECT CAST(min(started_at) AS DATE) AS a, CAST(max(started_at) AS DATE) AS b FROM [collection_runs] r), "
    + ("w AS (SELECT explode(sequence(a, b, INTERVAL 7 DAYS)) AS window_start, b FROM ends) SELECT window_start, least(date_add(window_start, 7), b) AS window_end FROM w" if d.spark
       else "w AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS window_start, b FROM ends) SELECT window_start, least(window_start + 7, b) AS window_end FROM w"))
QUERIES["ra_24_totals"] = "SELECT week, CAST(sum(articles_fetched) AS BIGINT) AS fetched, CAST(sum(articles_duplicates) AS BIGINT) AS duplicates, CAST(sum(sum(articles_fetched)) OVER (ORDER BY week) AS BIGINT) AS fetched_so_far FROM (SELECT *, CAST(floor((extract(DAY FROM started_at) - 1) / 7) AS INT) AS week FROM [collection_runs] r) x GROUP BY week"
QUERIES["ra_26_savings"] = f"SELECT {total_if('not_passed', 'skipped')}, round(sum(CASE WHEN not_passed THEN 1 ELSE 0 END) * (1500.0 / 1000000 * 3 + 500.0 / 1000000 * 15), 6) AS saved_usd FROM (SELECT probability < 0.5 AS not_passed FROM [classifier_predictions] p WHERE classifier_type = 'fp') x"
QUERIES["ra_27_rates"] = "SELECT status, articles, errors, CAST(errors AS DOUBLE) / nullif(articles, 0) AS error_rate, CAST(false_positives AS DOUBLE) / nullif(articles, 0) AS false_positive_rate, CAST(errors AS DOUBLE) / nullif(articles, 0) > 0.1 AS many_errors, CAST(false_positives AS DOUBLE) / nullif(articles, 0) > 0.5 AS many_false_positives FROM (SELECT scrape_status AS status, count(*) AS articles, " + total_if("labeling_status = 'failed'", "errors") + ", " + total_if("labeling_status = 'false_positive'", "false_positives") + " FROM [articles] t GROUP BY scrape_status) x"
QUERIES["rm_05_budget"] = "SELECT id, api_calls_made, greatest(0, 200 - api_calls_made) AS calls_left FROM [collection_runs] r"

# statistics
WORDS = "CAST(length(full_content) - length(replace(full_content, ' ', '')) + 1 AS BIGINT)"
QUERIES["sd_02_words"] = f"SELECT labeling_status, round(avg(n), 1) AS mean_words, round(CAST(median(n) AS DOUBLE), 1) AS median_words, round(stddev_samp(n), 1) AS std_words, min(n) AS min_words, max(n) AS max_words FROM (SELECT labeling_status, {WORDS} AS n FROM [articles] t) x GROUP BY labeling_status"
KINDS = (("table", " | "), ("shouting", "!!"), ("market", "stock"), ("paywall", "subscribe"))
QUERIES["sd_04_reasons"] = "SELECT brand, kind, count(*) AS n FROM (SELECT b.brand, CASE " + " ".join(f"WHEN contains(lower(a.full_content), '{w}') THEN '{k}'" for k, w in KINDS) + " ELSE 'other' END AS kind FROM [articles] a JOIN [article_brands] b ON b.id = a.id WHERE a.labeling_status IN ('false_positive', 'failed')) x GROUP BY brand, kind"
COUNTS = "SELECT brand, CAST(count(*) FILTER (WHERE labeling_status = 'labeled') AS DOUBLE) / nullif(sum(count(*) FILTER (WHERE labeling_status = 'labeled')) OVER (), 0) AS kept, CAST(count(*) FILTER (WHERE labeling_status <> 'labeled') AS DOUBLE) / nullif(sum(count(*) FILTER (WHERE labeling_status <> 'labeled')) OVER (), 0) AS dropped FROM [article_brands] b GROUP BY brand"
QUERIES["sd_06_discrimination"] = f"SELECT brand, round(ratio, 9) AS ratio, CASE WHEN ratio > 1.5 THEN 'keeps' WHEN ratio < 0.67 THEN 'drops' ELSE 'neutral' END AS label FROM (SELECT brand, (coalesce(kept, 0) + 0.001) / (coalesce(dropped, 0) + 0.001) AS ratio FROM ({COUNTS}) c) r"

# monitoring
BINS = "SELECT CASE WHEN created_at < {cut} THEN 0 ELSE 1 END AS side, CAST(floor(least(probability, 0.999999) * 10) AS INT) AS bin, count(*) AS n FROM [classifier_predictions] p GROUP BY 1, 2"
QUERIES["mo_03_column_drift"] = lambda d: (
    "WITH n AS (" + BINS.replace("{cut}", d.timestamp("2024-01-15 00:00:00")).replace("GROUP BY 1, 2", f"GROUP BY CASE WHEN created_at < {d.timestamp('2024-01-15 00:00:00')} THEN 0 ELSE 1 END, CAST(floor(least(probability, 0.999999) * 10) AS INT)")
    + "), s AS (SELECT bin, CAST(sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS DOUBLE) AS b FROM n GROUP BY bin), "
    "f AS (SELECT greatest(a / sum(a) OVER (), 0.0001) AS fa, greatest(b / sum(b) OVER (), 0.0001) AS fb FROM s) SELECT round(sum((fb - fa) * ln(fb / fa)), 9) AS stability_index, sum((fb - fa) * ln(fb / fa)) > 0.2 AS drifted FROM f")
QUERIES["mo_03_missing"] = "SELECT classifier_type, CAST(sum(CASE WHEN probability IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS missing_share FROM [classifier_predictions] p GROUP BY classifier_type"
KS = "SELECT classifier_type, v, CAST(sum(1 - side) AS DOUBLE) AS a, CAST(sum(side) AS DOUBLE) AS b FROM (SELECT classifier_type, round(probability, 3) AS v, CASE WHEN created_at < {cut} THEN 0 ELSE 1 END AS side FROM [classifier_predictions] p) x GROUP BY classifier_type, v"
QUERIES["wf_04_drift_summary"] = lambda d: (
    "WITH c AS (SELECT classifier_type, sum(a) OVER w / sum(a) OVER (PARTITION BY classifier_type) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY classifier_type) AS fb FROM (" + KS.replace("{cut}", d.timestamp("2024-01-15 00:00:00"))
    + ") g WINDOW w AS (PARTITION BY classifier_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), k AS (SELECT classifier_type, max(abs(fa - fb)) AS score FROM c GROUP BY classifier_type) "
    "SELECT count(*) AS classifiers, " + total_if("score > 0.05", "drifted") + ", CASE WHEN max(score) > 0.05 THEN 'retrain' ELSE 'none' END AS recommendation FROM k")
QUERIES["wf_05_feed_check"] = f"SELECT count(*) AS items, {total_if('title IS NULL OR title = ' + repr(''), 'without_title')}, {total_if('url IS NULL', 'without_url')}, {percent_if('brands_mentioned <> ' + repr(''), 'with_brands_pct')} FROM [articles] t"
QUERIES["rm_12_daily"] = "SELECT CAST(created_at AS DATE) AS day, count(*) AS articles, " + ", ".join(total_if(f"labeling_status = '{x}'", x) for x in ("labeled", "skipped", "failed", "false_positive", "pending")) + " FROM [articles] t GROUP BY CAST(created_at AS DATE)"
ORDERS["rm_12_daily"] = "day"

# evidence, nested and flat
QUERIES["ev_05_by_category"] = "SELECT b.article_id, b.brand, e.category, count(*) AS n, max(e.relevance_score) AS best, count(e.chunk_id) AS linked FROM [brand_labels] b JOIN [label_evidence] e ON e.brand_label_id = b.id GROUP BY b.article_id, b.brand, e.category"
QUERIES["tx_17_moods"] = "SELECT id, concat_ws('; ', " + ", ".join(f"CASE WHEN {f} THEN concat('{f}: ', CASE {m} WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' ELSE 'unclear' END) END" for f, m in MOOD.items()) + ") AS moods FROM [brand_labels] b"
