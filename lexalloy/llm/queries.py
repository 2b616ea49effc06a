"""The registered queries of the training-data operators and the SQL that some of them are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, decision_lists, decontamination, language_id, near_duplicates, packing, prefix_trie, secrets, text_stats, token_counts, toxicity, url_filters, vector_links, whitening
from .common import fold, held_out, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


#: The rules that the query is given.
OP3_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filtered(pages, OP3_RULES).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, one_in=20)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 4: where the rarest words of a test item stand near each other, by document and item."""
    benchmark = table(spark, sf_dir, "benchmark")
    index = decontamination.build_index(table(spark, sf_dir, "documents"), benchmark)
    return decontamination.proximity(index, benchmark).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_near"), F.min("position").alias("first"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 3 that rules alone decide."""
    return url_filters.with_rule(table(spark, sf_dir, "pages").select("page_id", "url"), OP3_RULES).drop("url")


URL_RULES_SQL = "WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r AS (SELECT rule, kind, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS s FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in OP3_RULES) + ") v(kind, rule)), f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS rule_verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id) SELECT p.*, f.rule, f.rule_verdict FROM p LEFT JOIN f USING (page_id)"


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 6 that the fixed patterns find, as their spans."""
    base = secrets.base_spans(F.coalesce(F.col("text"), F.lit("")))
    n = lambda kind: F.size(F.filter("base", lambda s: s.kind == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return table(spark, sf_dir, "documents").select("doc_id", base.alias("base")).select("doc_id", n("assign"), n("access"), n("hex"), secrets.joined(F.col("base")).alias("base_spans"))


def _spans_sql(kind: str, place: int) -> str:
    """(row, start, end, kind, place) of a base pattern: a match begins behind all pieces and matches before it."""
    pattern, group, least = secrets.BASE[kind]
    quoted = pattern.replace("'", "''")
    ahead = "list_sum(list_transform(p[: i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: i - 1], lambda x: length(x))), 0)"
    return f"SELECT row, {place} AS place, '{kind}' AS kind, s, s + length(m[i]) AS e FROM (SELECT row, m, g, i, CAST({ahead} AS BIGINT) AS s FROM (SELECT row, string_split(regexp_replace(t, '{quoted}', chr(1), 'g'), chr(1)) AS p, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g FROM d) x, unnest(range(1, len(m) + 1)) AS u(i)) y WHERE length(g[i]) >= {least}"


SECRET_BASE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_spans_sql(k, i) for i, k in enumerate(secrets.BASE)) + "), "
    "g AS (SELECT row, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE) + ", string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM s GROUP BY row) "
    "SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE) + ", coalesce(spans, '') AS base_spans FROM d LEFT JOIN g USING (row)"
)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of operator 7."""
    return text_stats.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *text_stats.BASE)


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT row, i, w[i : i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM g) x WHERE n > 1),
p AS (SELECT row, count(DISTINCT j) AS n FROM r, unnest(range(i, i + 3)) AS u(j) GROUP BY row),
l AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (row) LEFT JOIN p USING (row)
"""


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[s : s + 12] AS p FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(p) AS n FROM windows),
places AS (SELECT row, s, n, w[s : s + n - 1] AS p FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
hits AS (SELECT row, s, n, item_id FROM places JOIN windows USING (p)),
hit_words AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT row, s, n FROM hits), unnest(range(s, s + n)) AS t(k) GROUP BY row),
hit_items AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learned(docs, learn=fold("doc_id", 5) != 0)
    return language_id.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "langs", "proportions")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s.kind == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = decision_lists.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learned(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return toxicity.scored(docs, lexicon).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.grouped(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = boosting.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold("doc_id", 4) != 2)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=8)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    nodes = prefix_trie.trie(table(spark, sf_dir, "conversations"), head=fold("conv_id", 9), base=c - c % 5, longest=8)
    return nodes.drop("enter", "exit")


#: crc32 a bit at a time; prefixes as lists of turns.
OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce("text", '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM (SELECT DISTINCT c FROM t)),
ids AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda s, e: CASE WHEN xor(s, e) % 2 = 1 THEN xor(xor(s, e) // 2, 3988292384) ELSE xor(s, e) // 2 END), 4294967295) % 9 AS h FROM bits),
heads AS (SELECT ids.c, t.p, t.r, t.x FROM ids JOIN t ON t.c = ids.base AND t.p <= ids.h),
shared AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
turns AS (SELECT * FROM heads UNION ALL SELECT ids.c, t.p - ids.h + coalesce(shared.n, 0), t.r, t.x FROM ids JOIN t ON t.c = ids.c AND t.p > ids.h LEFT JOIN shared ON shared.c = ids.c),
pre AS (SELECT c, p AS d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY p) AS k, x FROM turns
  UNION ALL SELECT c, 0, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]), '' FROM ids),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(x)) AS saved FROM pre GROUP BY d, k),
linked AS (SELECT n.*, u.conv_id AS parent FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.k[1 : n.d - 1]),
children AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT l.*, coalesce(ch.n, 0) AS n_children FROM linked l LEFT JOIN children ch ON ch.d = l.d AND ch.conv_id = l.conv_id),
inside AS (SELECT u.d, u.conv_id, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum(n.saved) AS saved FROM whole n, unnest(range(0, n.d + 1)) AS a(up) JOIN nodes u ON u.d = a.up AND u.k = n.k[1 : a.up] GROUP BY 1, 2),
ends AS (SELECT n.d, n.conv_id, string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c) AS ids FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM pre GROUP BY c) e JOIN nodes n ON n.d = e.d AND n.k = e.k GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(i.n_leaves AS BIGINT) AS n_leaves, CAST(i.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM whole w JOIN inside i ON i.d = w.d AND i.conv_id = w.conv_id LEFT JOIN ends e ON e.d = w.d AND e.conv_id = w.conv_id
"""


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.grouped(table(spark, sf_dir, "embeddings"), threshold=0.95).select("vec_id", "n_links", "component_id", "kept")


OP13_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT row, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(e, e) > 0),
near AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.row <> b.row AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach AS (SELECT row AS a, row AS b FROM v UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a),
least AS (SELECT reach.a, min(v.vec_id) AS component FROM reach JOIN v ON v.row = reach.b GROUP BY reach.a)
SELECT v.vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, least.component AS component_id, v.vec_id = least.component AS kept FROM v LEFT JOIN links ON links.a = v.row LEFT JOIN least ON least.a = v.row
"""


QUERIES = {"op3_url_filters": op3_url_filters, "op9_near_duplicates": op9_near_duplicates, "op5_language_id": op5_language_id, "op6_secrets": op6_secrets, "op7_quality_rules": op7_quality_rules, "op8_toxicity": op8_toxicity, "op10_quality_classifier": op10_quality_classifier, "op4_decontamination": op4_decontamination, "op1_packing": op1_packing, "op2_token_counts": op2_token_counts, "op11_whitening": op11_whitening, "op12_prefix_trie": op12_prefix_trie, "op13_vector_links": op13_vector_links, "decontamination_proximity": decontamination_proximity, "url_rules": url_rules, "secret_base": secret_base, "quality_base": quality_base}

ORACLES: dict[str, str] = {"op4_decontamination": OP4_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_links": OP13_SQL, "url_rules": URL_RULES_SQL, "secret_base": SECRET_BASE_SQL, "quality_base": QUALITY_BASE_SQL}
