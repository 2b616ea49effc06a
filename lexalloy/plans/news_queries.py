"""The monitoring and reporting statements over the news tables. Each is one plan; its text serves both engines.

Orders that a limit follows are total (an id breaks ties), and nulls are placed as in the originals: first when falling,
last when rising. Wall-clock ``now`` is a parameter of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from .tables import Dialect

#: Statement by name; a function of the dialect where the engines differ.
QUERIES: dict[str, str | Callable[[Dialect], str]] = {}


def share(table: str, column: str) -> str:
    """Rows of each value of a column and their percentage of all rows."""
    return f"SELECT {column}, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DOUBLE) AS percentage FROM [{table}] t GROUP BY {column}"


def total_if(test: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


def percent_if(test: str, name: str) -> str:
    return f"CAST(round(100.0 * sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*), 1) AS DOUBLE) AS {name}"


def mean(column: str, digits: int) -> str:
    """A rounded average of decimals: the sum is exact, so that its order can't tip the rounding."""
    return f"CAST(round(avg(CAST({column} AS DECIMAL(28, 12))), {digits}) AS DOUBLE)"


def histogram(table: str, column: str, steps: list[tuple[str, str]], rest: str, label: str, measures: str, nulls: str = "", order: str = "") -> str:
    """Rows by the first test that a column passes, with measures; order may be by an aggregate that isn't selected."""
    case = " ".join(f"WHEN {column} {test} THEN '{name}'" for test, name in steps)
    return f"SELECT {label}, count(*) AS n, {measures} FROM (SELECT t.*, CASE {case} ELSE '{rest}' END AS {label} FROM [{table}] t {nulls}) b GROUP BY {label}{order and ' ORDER BY ' + order}"


def latest(table: str, columns: str, n: int, where: str = "true", by: str = "created_at DESC NULLS FIRST") -> str:
    return f"SELECT {columns} FROM [{table}] t WHERE {where} ORDER BY {by}, id LIMIT {n}"


def day(column: str) -> str:
    return f"CAST({column} AS DATE)"


# articles
QUERIES["q_art_01"] = latest("articles", f"id, left(title, 60) AS title, source_name, brands_mentioned, scrape_status, labeling_status, {day('published_at')} AS published", 20)
QUERIES["q_art_02"] = latest("articles", f"id, left(title, 50) AS title, CAST(length(full_content) AS BIGINT) AS content_length, n_brands AS num_brands, {day('published_at')} AS published", 20, "scrape_status = 'success' AND full_content IS NOT NULL")
QUERIES["q_art_03"] = "SELECT brand, count(*) AS article_count FROM [article_brands] b GROUP BY brand"
QUERIES["q_art_04"] = latest("articles", f"id, left(title, 60) AS title, brands_mentioned, n_brands AS num_brands, {day('published_at')} AS published", 20, "n_brands > 1", "n_brands DESC NULLS FIRST, published_at DESC NULLS FIRST")
QUERIES["q_art_05"] = lambda d: "SELECT brand1, brand2, count(*) AS co_occurrences FROM (SELECT split(brands_mentioned, ',') AS brands FROM [articles] t WHERE n_brands > 1) a LATERAL VIEW explode(brands) AS brand1 LATERAL VIEW explode(brands) AS brand2 WHERE brand1 < brand2 GROUP BY brand1, brand2 ORDER BY co_occurrences DESC, brand1, brand2 LIMIT 20" if d.spark else "SELECT x.brand AS brand1, y.brand AS brand2, count(*) AS co_occurrences FROM [article_brands] x JOIN [article_brands] y ON x.id = y.id AND x.brand < y.brand GROUP BY x.brand, y.brand ORDER BY co_occurrences DESC, brand1, brand2 LIMIT 20"
QUERIES["q_art_06"] = histogram("articles", "length(full_content)", [("< 1000", "short"), ("< 3000", "medium"), ("< 6000", "long")], "very long", "content_size", "round(avg(length(full_content)), 0) AS avg_chars", "WHERE full_content IS NOT NULL", "min(length(full_content))")
QUERIES["q_art_07"] = latest("articles", f"id, left(title, 70) AS title, brands_mentioned, {day('published_at')} AS published", 20, "lower(title) LIKE '%thin%'", "published_at DESC NULLS FIRST")
QUERIES["q_art_08"] = latest("articles", "id, left(title, 60) AS title, brands_mentioned, left(full_content, 200) AS content_preview", 10, "full_content ILIKE '%The And%'", "published_at DESC NULLS FIRST")
QUERIES["q_art_09"] = f"SELECT source_name, count(*) AS articles, count(CASE WHEN scrape_status = 'success' THEN 1 END) AS scraped, min({day('published_at')}) AS earliest, max({day('published_at')}) AS latest FROM [articles] t GROUP BY source_name ORDER BY articles DESC, source_name LIMIT 25"
QUERIES["q_art_10"] = f"SELECT source_name, count(*) AS total_articles, {percent_if("scrape_status = " + repr("success"), "scrape_success_pct")}, round(avg(length(full_content)), 0) AS avg_content_length FROM [articles] t GROUP BY source_name HAVING count(*) >= 5 ORDER BY scrape_success_pct DESC, avg_content_length DESC, source_name LIMIT 20"
QUERIES["q_art_11"] = "SELECT id, title, url FROM [articles] t WHERE url LIKE '%src1.example.com%' ORDER BY id LIMIT 10"

# collection
SUCCESS, FAILED = "scrape_status = 'success'", "scrape_status = 'failed'"
QUERIES["q_col_01"] = "SELECT count(*) AS total_articles FROM [articles] t"
QUERIES["q_col_02"] = share("articles", "scrape_status")
QUERIES["q_col_03"] = f"SELECT source_name, count(*) AS articles, min({day('published_at')}) AS earliest, max({day('published_at')}) AS latest FROM [articles] t GROUP BY source_name ORDER BY articles DESC, source_name LIMIT 20"
QUERIES["q_col_04"] = lambda d: latest("collection_runs", f"id, {d.local('started_at')} AS started_local, status, api_calls_made, articles_fetched, articles_duplicates, articles_scraped, articles_scrape_failed, CAST({d.seconds('started_at', 'completed_at')} AS BIGINT) AS duration_seconds", 10, by="started_at DESC NULLS FIRST")
QUERIES["q_col_05"] = f"SELECT {day('started_at')} AS run_date, count(*) AS runs, CAST(sum(api_calls_made) AS BIGINT) AS total_api_calls, CAST(sum(articles_fetched) AS BIGINT) AS total_fetched, CAST(sum(articles_duplicates) AS BIGINT) AS total_duplicates, CAST(sum(articles_scraped) AS BIGINT) AS total_scraped FROM [collection_runs] t GROUP BY {day('started_at')} ORDER BY run_date DESC LIMIT 14"
QUERIES["q_col_06"] = latest("collection_runs", "id, started_at, status, error_message, api_calls_made, articles_fetched", 10, "status <> 'success'", "started_at DESC NULLS FIRST")
QUERIES["q_col_07"] = "SELECT count(*) AS pending_scrape FROM [articles] t WHERE scrape_status = 'pending'"
QUERIES["q_col_08"] = latest("articles", f"id, left(title, 50) AS title, url, scrape_error, {day('created_at')} AS created", 20, FAILED)
QUERIES["q_col_09"] = f"SELECT source_name, count(*) AS total, {total_if(SUCCESS, 'scraped')}, {total_if(FAILED, 'failed')}, {percent_if(SUCCESS, 'success_rate')} FROM [articles] t GROUP BY source_name HAVING count(*) >= 5"
QUERIES["q_col_10"] = f"SELECT {day('created_at')} AS collection_date, count(*) AS articles FROM [articles] t GROUP BY {day('created_at')} ORDER BY collection_date DESC LIMIT 30"
QUERIES["q_col_11"] = f"SELECT {day('published_at')} AS publish_date, count(*) AS articles FROM [articles] t WHERE published_at IS NOT NULL GROUP BY {day('published_at')} ORDER BY publish_date DESC LIMIT 30"
QUERIES["q_col_12"] = lambda d: f"WITH ends AS (SELECT min({day('created_at')}) AS a FROM [articles] t), all_days AS (SELECT {d.days('a', 'DATE ' + repr('2024-03-05'))} AS day FROM ends) SELECT day AS missing_date FROM all_days LEFT ANTI JOIN (SELECT DISTINCT {day('created_at')} AS day FROM [articles] t) seen USING (day)" if d.spark else f"WITH ends AS (SELECT min({day('created_at')}) AS a FROM [articles] t), all_days AS (SELECT {d.days('a', 'DATE ' + repr('2024-03-05'))} AS day FROM ends) SELECT day AS missing_date FROM all_days WHERE day NOT IN (SELECT {day('created_at')} FROM [articles] t)"
QUERIES["q_col_13"] = f"SELECT scrape_error, count(*) AS n FROM [articles] t WHERE {FAILED} GROUP BY scrape_error ORDER BY n DESC, scrape_error LIMIT 10"
QUERIES["q_col_14"] = lambda d: latest("collection_runs", f"id, {day('started_at')} AS run_date, {d.clock('started_at')} AS run_time, status, articles_fetched, articles_scraped, articles_scrape_failed", 10, by="started_at DESC NULLS FIRST")

# evidence
QUERIES["q_evi_01"] = f"SELECT category, count(*) AS evidence_count, {mean('relevance_score', 3)} AS avg_relevance FROM [label_evidence] t GROUP BY category"
QUERIES["q_evi_02"] = "SELECT match_quality, n, CAST(round(100.0 * n / sum(n) OVER (), 1) AS DOUBLE) AS percentage FROM (" + histogram("label_evidence", "relevance_score", [("= 1.0", "exact match"), (">= 0.85", "high confidence"), (">= 0.7", "medium confidence"), ("> 0", "low confidence")], "no match", "match_quality", "min(relevance_score) AS least") + ") h ORDER BY least DESC NULLS FIRST"
QUERIES["q_evi_03"] = "SELECT CASE WHEN chunk_id IS NULL THEN 'unlinked' ELSE 'linked' END AS link, count(*) AS n FROM [label_evidence] t GROUP BY chunk_id IS NULL"
QUERIES["q_evi_04"] = "SELECT e.id, e.category, left(e.excerpt, 100) AS evidence, e.relevance_score, b.confidence_score AS label_confidence FROM [label_evidence] e JOIN [brand_labels] b ON e.brand_label_id = b.id WHERE b.brand = 'thatin'"
QUERIES["q_evi_05"] = f"SELECT b.brand, e.category, count(*) AS evidence_count, {mean('e.relevance_score', 2)} AS avg_relevance FROM [label_evidence] e JOIN [brand_labels] b ON e.brand_label_id = b.id GROUP BY b.brand, e.category"
QUERIES["q_evi_06"] = f"SELECT b.brand, count(DISTINCT b.id) AS labels, count(e.id) AS total_evidence, {mean('e.relevance_score', 2)} AS avg_relevance FROM [brand_labels] b LEFT JOIN [label_evidence] e ON e.brand_label_id = b.id GROUP BY b.brand"
QUERIES["q_evi_07"] = "SELECT a.id AS article_id, left(a.title, 40) AS title, count(c.id) AS chunk_count, CAST(sum(c.token_count) AS BIGINT) AS total_tokens, round(avg(c.token_count), 0) AS avg_chunk_tokens FROM [articles] a JOIN [article_chunks] c ON c.article_id = a.id GROUP BY a.id, a.title ORDER BY chunk_count DESC, article_id LIMIT 20"
QUERIES["q_evi_08"] = "SELECT CASE WHEN has_embedding THEN 'has embedding' ELSE 'no embedding' END AS embedding_status, count(*) AS chunk_count FROM [article_chunks] t GROUP BY has_embedding"
QUERIES["q_evi_09"] = histogram("article_chunks", "token_count", [("< 200", "small"), ("< 400", "medium"), ("< 600", "target")], "large", "size_bucket", "round(avg(token_count), 0) AS avg_tokens", order="min(token_count)")
QUERIES["q_evi_10"] = "SELECT e.id AS evidence_id, left(a.title, 40) AS article_title, b.brand, e.category, left(e.excerpt, 80) AS evidence_excerpt, left(c.chunk_text, 100) AS source_chunk, e.relevance_score FROM [label_evidence] e JOIN [brand_labels] b ON e.brand_label_id = b.id JOIN [articles] a ON b.article_id = a.id LEFT JOIN [article_chunks] c ON e.chunk_id = c.id WHERE e.chunk_id IS NOT NULL ORDER BY a.title, b.brand, e.id LIMIT 20"
QUERIES["q_evi_11"] = "SELECT e.id AS evidence_id, b.brand, e.category, left(e.excerpt, 100) AS unmatched_evidence, e.relevance_score FROM [label_evidence] e JOIN [brand_labels] b ON e.brand_label_id = b.id WHERE e.chunk_id IS NULL ORDER BY b.brand, e.category, e.id LIMIT 20"
QUERIES["q_evi_12"] = lambda d: f"SELECT r.id AS run_id, {day('r.started_at')} AS run_date, count(e.id) AS total_evidence, {mean('e.relevance_score', 3)} AS avg_relevance, {total_if('e.chunk_id IS NOT NULL', 'linked_count')} FROM [labeling_runs] r JOIN [brand_labels] b ON b.labeled_at BETWEEN r.started_at AND coalesce(r.completed_at, {d.timestamp('2024-03-05 00:00:00')}) JOIN [label_evidence] e ON e.brand_label_id = b.id GROUP BY r.id, r.started_at"
QUERIES["q_evi_13"] = "SELECT category, left(excerpt, 80) AS evidence_pattern, count(*) AS occurrences FROM [label_evidence] t GROUP BY category, left(excerpt, 80) HAVING count(*) > 1"

# labelling
FLAGS = ("environmental", "social", "governance", "digital_transformation")
MOOD = {f: f"{f.split('_')[0]}_sentiment" for f in FLAGS}


FLAG_COUNT = "(" + " + ".join(f"CASE WHEN b.{f} THEN 1 ELSE 0 END" for f in FLAGS) + ")"
BEFORE = "2024-02-15 00:13:57"
QUERIES["q_lab_01"] = share("articles", "labeling_status")
QUERIES["q_lab_02"] = f"SELECT count(*) AS ready_to_label FROM [articles] t WHERE {SUCCESS} AND labeling_status = 'pending' AND full_content IS NOT NULL"
QUERIES["q_lab_03"] = lambda d: latest("articles", f"id, left(title, 50) AS title, labeling_status, {d.local('labeled_at')} AS labeled_local, n_brands AS brands", 20, "labeled_at IS NOT NULL", "labeled_at DESC NULLS FIRST")
QUERIES["q_lab_04"] = f"SELECT brand, count(*) AS total_labels, {', '.join(total_if(f, f) for f in FLAGS)} FROM [brand_labels] t GROUP BY brand"
QUERIES["q_lab_05"] = f"SELECT brand, count(*) AS total, {', '.join(percent_if(f, f + '_pct') for f in FLAGS)} FROM [brand_labels] t GROUP BY brand HAVING count(*) >= 3"
# each label gives a row a category in one pass, whatever the number of categories
STACKED = "SELECT brand, CASE f.k " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FLAGS)) + " END AS category, CASE f.k " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FLAGS)) + " END AS applies, CASE f.k " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(MOOD.values())) + " END AS mood FROM [brand_labels] t CROSS JOIN (VALUES " + ", ".join(f"({i})" for i in range(len(FLAGS))) + ") f(k)"
MOODS = ", ".join(total_if(f"mood = {v}", n) for n, v in (("positive", 1), ("neutral", 0), ("negative", -1)))
QUERIES["q_lab_06"] = f"SELECT brand, category, {MOODS} FROM ({STACKED}) s WHERE applies GROUP BY brand, category"
QUERIES["q_lab_07"] = f"SELECT category, {MOODS}, count(*) FILTER (WHERE applies) AS total FROM ({STACKED}) s GROUP BY category"
QUERIES["q_lab_08"] = histogram("brand_labels", "confidence_score", [(">= 0.9", "high"), (">= 0.7", "medium"), (">= 0.5", "low")], "very low", "confidence_level", mean("confidence_score", 3) + " AS avg_confidence", order="min(confidence_score) DESC")
QUERIES["q_lab_09"] = f"SELECT b.id, b.brand, left(a.title, 50) AS article_title, {', '.join('b.' + f for f in FLAGS)}, b.confidence_score FROM [brand_labels] b JOIN [articles] a ON b.article_id = a.id WHERE b.confidence_score < 0.7 ORDER BY b.confidence_score, b.id LIMIT 20"
QUERIES["q_lab_10"] = f"SELECT brand, count(*) AS labels, {mean('confidence_score', 3)} AS avg_confidence, round(min(confidence_score), 3) AS min_confidence, round(max(confidence_score), 3) AS max_confidence FROM [brand_labels] t GROUP BY brand"
QUERIES["q_lab_11"] = lambda d: latest("labeling_runs", f"id, {d.local('started_at')} AS started_local, status, articles_processed, brands_labeled, llm_calls_made, total_input_tokens, total_output_tokens, round(estimated_cost_usd, 4) AS cost_usd", 10, by="started_at DESC NULLS FIRST")
QUERIES["q_lab_12"] = "SELECT count(*) AS total_runs, CAST(sum(articles_processed) AS BIGINT) AS total_articles, CAST(sum(brands_labeled) AS BIGINT) AS total_labels, CAST(sum(llm_calls_made) AS BIGINT) AS total_llm_calls, CAST(sum(total_input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(total_output_tokens) AS BIGINT) AS total_output_tokens, CAST(round(sum(CAST(estimated_cost_usd AS DECIMAL(28, 12))), 2) AS DOUBLE) AS total_cost_usd FROM [labeling_runs] t WHERE status = 'success'"
QUERIES["q_lab_13"] = latest("labeling_runs", f"id, {day('started_at')} AS run_date, articles_processed, round(estimated_cost_usd, 4) AS cost, round(estimated_cost_usd / nullif(articles_processed, 0), 4) AS cost_per_article", 10, "articles_processed > 0", "started_at DESC NULLS FIRST")
QUERIES["q_lab_14"] = f"SELECT b.id, b.brand, left(a.title, 40) AS title, {', '.join(f'b.{f}, b.{m}' for f, m in MOOD.items())}, b.confidence_score, {day('a.published_at')} AS published FROM [brand_labels] b JOIN [articles] a ON b.article_id = a.id ORDER BY b.labeled_at DESC NULLS FIRST, b.id LIMIT 20"
QUERIES["q_lab_15"] = f"SELECT b.id, b.brand, left(a.title, 60) AS title, b.confidence_score FROM [brand_labels] b JOIN [articles] a ON b.article_id = a.id WHERE {' AND '.join(f'b.{f} = false' for f in FLAGS)} ORDER BY b.labeled_at DESC NULLS FIRST, b.id"
QUERIES["q_lab_16"] = f"SELECT b.id, b.brand, left(a.title, 50) AS title, CAST({FLAG_COUNT} AS BIGINT) AS category_count, b.confidence_score FROM [brand_labels] b JOIN [articles] a ON b.article_id = a.id WHERE {FLAG_COUNT} >= 2 ORDER BY category_count DESC, b.confidence_score DESC, b.id LIMIT 20"
QUERIES["q_lab_17"] = latest("articles", "id, left(title, 60) AS title, labeling_status, labeling_error, CAST(length(full_content) AS BIGINT) AS content_length", 20, "labeling_status = 'skipped'", "labeled_at DESC NULLS FIRST")
QUERIES["q_lab_18"] = "SELECT id, left(title, 60) AS title, labeling_error, labeled_at FROM [articles] t WHERE labeling_status = 'failed'"
QUERIES["q_lab_19"] = lambda d: f"SELECT labeling_status, count(*) AS n FROM [articles] t WHERE labeled_at < {d.timestamp(BEFORE)} GROUP BY labeling_status"
QUERIES["q_lab_20"] = lambda d: f"SELECT b.id, a.title, a.source_name, b.brand, a.labeled_at FROM [articles] a JOIN [brand_labels] b ON b.article_id = a.id WHERE a.labeled_at < {d.timestamp(BEFORE)} AND (" + " OR ".join(f"a.title ILIKE '%{w}%'" for w in ("Stin", "hand", "ther in", "short interest")) + ")"
QUERIES["q_lab_21"] = "SELECT id, title, source_name, brands_mentioned FROM [articles] a WHERE labeling_status = 'skipped' AND (" + " OR ".join(f"title ILIKE '%{w}%'" for w in ("stin", "hand", "thin", "short interest", "ERER", "ex-", "ent", "joins")) + ") ORDER BY created_at DESC NULLS FIRST, id"

# run and prediction reports
QUERIES["rs_01"] = lambda d: f"SELECT count(*) AS runs, CAST(coalesce(sum(articles_fetched), 0) AS BIGINT) AS fetched, CAST(coalesce(sum(articles_scraped), 0) AS BIGINT) AS scraped, CAST(coalesce(sum(articles_scrape_failed), 0) AS BIGINT) AS failed FROM [collection_runs] t WHERE started_at >= {d.timestamp('2024-01-30 00:00:00')} - INTERVAL 24 HOUR"
QUERIES["rs_02"] = "SELECT labeling_status, count(*) AS n FROM [articles] t GROUP BY labeling_status"
QUERIES["rs_03"] = "SELECT 'articles' AS name, count(*) AS n FROM [articles] t UNION ALL SELECT 'brand_labels', count(*) FROM [brand_labels] t UNION ALL SELECT 'label_evidence', count(*) FROM [label_evidence] t"
QUERIES["rs_04"] = lambda d: f"SELECT p.id, p.created_at AS predicted_at, p.probability, p.prediction, CAST(length(concat(a.title, ' ', coalesce(a.full_content, ''))) AS BIGINT) AS text_length FROM [classifier_predictions] p JOIN [articles] a ON p.article_id = a.id WHERE p.classifier_type = 'fp' AND p.created_at BETWEEN {d.timestamp('2024-01-05 00:00:00')} AND {d.timestamp('2024-01-25 00:00:00')}"
QUERIES["ra_04"] = "SELECT " + ", ".join(total_if(f"labeling_status = '{s}'", s) for s in ("pending", "labeled", "skipped", "failed", "false_positive")) + ", count(*) AS articles, (SELECT count(*) FROM [article_chunks] c) AS chunks, (SELECT count(*) FROM [brand_labels] b) AS labels FROM [articles] t"
QUERIES["ra_05"] = "SELECT brand, id, place_in_brand FROM (SELECT brand, id, CAST(row_number() OVER (PARTITION BY brand ORDER BY created_at DESC, id) AS BIGINT) AS place_in_brand FROM [article_brands] b WHERE labeling_status IN ('labeled', 'skipped')) r WHERE place_in_brand <= 5"
QUERIES["ra_07"] = "SELECT id, title, coalesce(nullif(full_content, ''), '') AS content, CASE labeling_status WHEN 'false_positive' THEN 0 ELSE 1 END AS is_relevant FROM [articles] t WHERE labeling_status IN ('labeled', 'skipped', 'false_positive')"
QUERIES["ra_08"] = f"SELECT a.id, CASE WHEN f.article_id IS NULL THEN 0 ELSE 1 END AS has_category FROM [articles] a LEFT JOIN (SELECT DISTINCT article_id FROM [brand_labels] b WHERE {' OR '.join(FLAGS)}) f ON f.article_id = a.id WHERE a.labeling_status IN ('labeled', 'skipped')"
QUERIES["ra_09"] = f"SELECT b.id, a.title, b.brand, {', '.join(f'CASE WHEN b.{f} THEN 1 ELSE 0 END AS {f}, b.{m}' for f, m in MOOD.items())} FROM [articles] a JOIN [brand_labels] b ON b.article_id = a.id WHERE a.labeling_status = 'labeled'"
QUERIES["ra_10"] = "SELECT brand, count(*) AS n FROM [article_brands] b GROUP BY brand ORDER BY n DESC, brand LIMIT 10"
QUERIES["ra_11"] = "SELECT id FROM (SELECT id, n_brands, row_number() OVER (PARTITION BY CASE WHEN trim(title) = '' THEN concat('#', id) ELSE lower(trim(title)) END ORDER BY created_at, id) AS k FROM [articles] t) r WHERE k = 1 AND n_brands > 0"
QUERIES["ra_19"] = "SELECT id, concat_ws(' | ', CASE WHEN brands_mentioned <> '' THEN concat('Brands: ', brands_mentioned) END, CASE WHEN labeling_error IS NOT NULL THEN concat('Note: ', labeling_error) END, concat('Source: ', source_name)) AS summary FROM [articles] t"
QUERIES["ra_25"] = "SELECT id, round(CAST(total_input_tokens AS DOUBLE) / 1000000 * 3 + CAST(total_output_tokens AS DOUBLE) / 1000000 * 15 + CAST(brands_labeled AS DOUBLE) * 500 / 1000 * 0.00002, 6) AS cost_usd FROM [labeling_runs] t"
QUERIES["ra_27"] = "SELECT id, articles_processed, round(CAST(brands_labeled AS DOUBLE) / nullif(articles_processed, 0), 4) AS label_rate, CAST(brands_labeled AS DOUBLE) / nullif(articles_processed, 0) > 0.5 AS flagged FROM [labeling_runs] t"
QUERIES["sc_21"] = "SELECT id, CASE environmental_sentiment WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END AS mood FROM [brand_labels] b"
QUERIES["sc_23"] = "SELECT id, CASE WHEN relevance_score >= 0.85 THEN 'high' WHEN relevance_score >= 0.7 THEN 'medium' WHEN relevance_score >= 0.5 THEN 'low' ELSE 'unmatched' END AS confidence FROM [label_evidence] e"
QUERIES["sc_24"] = "SELECT id, CASE WHEN probability < 0.3 THEN 'low' WHEN probability < 0.6 THEN 'medium' ELSE 'high' END AS confidence FROM [classifier_predictions] p"
QUERIES["sc_18"] = "SELECT id, md5(url) AS hashed FROM [articles] t"
QUERIES["sc_19"] = lambda d: f"SELECT id, left({'sha2(full_content, 256)' if d.spark else 'sha256(full_content)'}, 12) AS hashed FROM [articles] t"

# statistics and monitoring
QUERIES["sd_01"] = "SELECT labeling_status, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage, CAST(max(count(*)) OVER () AS DOUBLE) / min(count(*)) OVER () AS imbalance FROM [articles] t GROUP BY labeling_status"
QUERIES["sd_02"] = "SELECT labeling_status, round(avg(length(full_content)), 1) AS mean_chars, round(CAST(median(length(full_content)) AS DOUBLE), 1) AS median_chars, round(stddev_samp(length(full_content)), 1) AS std_chars, CAST(min(length(full_content)) AS BIGINT) AS min_chars, CAST(max(length(full_content)) AS BIGINT) AS max_chars FROM [articles] t GROUP BY labeling_status"
QUERIES["sd_03"] = "SELECT brand, labeling_status, count(*) AS n FROM [article_brands] b GROUP BY brand, labeling_status"
QUERIES["ml_06"] = "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / nullif(tp + fp, 0), 9) AS precision_1, round(tp / nullif(tp + fn, 0), 9) AS recall_1 FROM (SELECT " + ", ".join(f"CAST(sum(CASE WHEN {t} THEN 1 ELSE 0 END) AS DOUBLE) AS {n}" for n, t in (("tp", "p AND y"), ("fp", "p AND NOT y"), ("fn", "NOT p AND y"), ("tn", "NOT p AND NOT y"))) + " FROM (SELECT probability >= 0.2 AS p, article_id % 3 = 0 AS y FROM [classifier_predictions] c) x) c"
CURVE = "SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS found, sum(pos) OVER () AS positives FROM (SELECT round(probability, 6) AS score, sum(CASE WHEN article_id % 3 = 0 THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM [classifier_predictions] c GROUP BY round(probability, 6)) s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
QUERIES["ml_13"] = f"SELECT max(score) AS threshold FROM ({CURVE}) c WHERE tp >= 0.99 * positives"
QUERIES["ml_14"] = f"SELECT t.target, max(c.score) AS threshold FROM ({CURVE}) c JOIN (SELECT 0.90 AS target UNION ALL SELECT 0.95 UNION ALL SELECT 0.97 UNION ALL SELECT 0.98 UNION ALL SELECT 0.99) t ON c.tp >= t.target * c.positives GROUP BY t.target"
QUERIES["mo_02"] = lambda d: f"WITH s AS (SELECT round(probability, 6) AS v, CASE WHEN created_at < {d.timestamp('2024-01-15 00:00:00')} THEN 0 ELSE 1 END AS side FROM [classifier_predictions] p), g AS (SELECT v, CAST(sum(1 - side) AS DOUBLE) AS a, CAST(sum(side) AS DOUBLE) AS b FROM s GROUP BY v), c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM g WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(max(abs(fa - fb)), 9) AS ks_statistic, max(abs(fa - fb)) > 0.1 AS drifted FROM c"
QUERIES["mo_04"] = f"SELECT classifier_type, count(*) AS n, min(created_at) AS earliest, max(created_at) AS latest, {mean('probability', 6)} AS mean_probability, round(stddev_samp(probability), 6) AS std_probability, round(avg(prediction), 6) AS positive_rate FROM [classifier_predictions] p GROUP BY classifier_type"
QUERIES["wf_03"] = "SELECT count(*) AS records, count(*) >= 500 AS enough, CAST(sum(CASE WHEN labeling_status = 'labeled' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN labeling_status = 'false_positive' THEN 1 ELSE 0 END), 0) > 10 AS imbalanced FROM [articles] t WHERE labeling_status IN ('labeled', 'false_positive')"
# An item's inner words stand in a text that holds it: its longest one is the key, the whole item is checked then. Items
# of one or two words have no inner word and are held against every text.
INNER = "SELECT item_id, trim(text) AS item, array_sort(transform(slice(split(trim(text), ' '), 2, greatest(size(split(trim(text), ' ')) - 2, 0)), w -> struct(length(w) AS n, w AS w))) AS inner_words FROM {benchmark} b"
QUERIES["ev_exact"] = lambda d: (
    f"WITH i AS (SELECT item_id, item, element_at(inner_words, -1).w AS word FROM ({INNER}) x WHERE size(inner_words) > 0), s AS (SELECT item_id, item FROM ({INNER}) x WHERE size(inner_words) = 0), "
    "w AS (SELECT doc_id, text, explode(array_distinct(split(text, ' '))) AS word FROM {documents} t) "
    "SELECT i.item_id, w.doc_id FROM w JOIN i ON i.word = w.word AND contains(w.text, i.item) UNION ALL SELECT s.item_id, t.doc_id FROM s JOIN {documents} t ON contains(t.text, s.item)"
    if d.spark else "SELECT b.item_id, t.doc_id FROM {benchmark} b JOIN {documents} t ON contains(t.text, trim(b.text))"
)

#: Final orders without a limit: what a reader sees first. Ids and names break ties.
ORDERS = {
    "q_art_03": "article_count DESC, brand", "q_col_02": "n DESC, scrape_status", "q_col_09": "success_rate DESC, source_name", "q_col_12": "missing_date DESC", "q_evi_01": "evidence_count DESC, category",
    "q_evi_04": "category, relevance_score DESC, id", "q_evi_05": "brand, evidence_count DESC, category", "q_evi_06": "total_evidence DESC, brand", "q_evi_12": "run_date DESC, run_id", "q_evi_13": "category, occurrences DESC, evidence_pattern",
    "q_lab_01": "n DESC, labeling_status", "q_lab_04": "total_labels DESC, brand", "q_lab_05": "total DESC, brand", "q_lab_06": "brand, category", "q_lab_07": "category", "q_lab_10": "avg_confidence DESC, brand", "q_lab_18": "labeled_at DESC NULLS FIRST, id", "q_lab_20": "labeled_at DESC NULLS FIRST, id",
}

