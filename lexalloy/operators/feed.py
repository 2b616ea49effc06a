"""The news feed and audits: nested articles with labels and evidence, rule audits, re-extraction, rechunking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mood, snippet
from .matching import chunks, matched


def newest(articles: DataFrame, n: int, by: str = "published_at", id_col: str = "id") -> DataFrame:
    """The n newest articles; undated ones last."""
    return articles.orderBy(F.desc_nulls_last(by), id_col).limit(n)


def feed_items(articles: DataFrame, labels: DataFrame, evidence: DataFrame, chunk_texts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row an article: its columns, and brands, categories (sorted sets), labels: array of (brand, category, sentiment, evidence: array of
    (excerpt, confidence, snippet)). A sentiment is given only where the category applies; articles without labels have empty arrays.

    labels: id, article_id, brand, a boolean column a category and ``{first word}_sentiment``; evidence: id, brand_label_id, category
    (a category's first word or name), excerpt, relevance_score, chunk_id; chunk_texts: id, chunk_text."""
    ids = articles.select(F.col("id").alias("article_id"))
    mine = labels.join(ids, "article_id", "left_semi")
    stacked = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("applies"), F.col(f"{c.split('_')[0]}_sentiment").alias("sentiment")) for c in categories])
    applied = mine.select(F.col("id").alias("label_id"), "article_id", "brand", F.inline(stacked)).filter("applies")
    said = evidence.join(mine.select(F.col("id").alias("brand_label_id")), "brand_label_id", "left_semi").join(chunk_texts.select(F.col("id").alias("chunk_id"), "chunk_text"), "chunk_id", "left")
    level = F.when(F.col("relevance_score") >= 0.85, "high").when(F.col("relevance_score") >= 0.7, "medium").when(F.col("relevance_score") >= 0.5, "low").otherwise("unmatched")
    item = F.struct(F.col("id"), F.col("excerpt"), level.alias("confidence"), F.when(F.col("chunk_text").isNotNull(), snippet(F.col("chunk_text"), F.col("excerpt"))).alias("snippet"))
    grouped = said.groupBy(F.col("brand_label_id").alias("label_id"), F.split("category", "_")[0].alias("kind")).agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    full = applied.withColumn("kind", F.split("category", "_")[0]).join(grouped, ["label_id", "kind"], "left")
    none = F.array().cast(grouped.schema["evidence"].dataType)
    label = F.struct("brand", "category", mood(F.col("sentiment")).alias("sentiment"), F.coalesce("evidence", none).alias("evidence"))
    by_article = full.groupBy("article_id").agg(F.sort_array(F.collect_set("brand")).alias("brands"), F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_list(label)).alias("labels"))
    out = articles.join(by_article, F.col("id") == F.col("article_id"), "left").drop("article_id")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(by_article.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("brands", "categories", "labels")})


def feed_sets(items: DataFrame) -> DataFrame:
    """One row: all brands and all categories of a feed, sorted."""
    return items.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("brands")))).alias("brands"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))


def feed_tops(items: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n commonest entries of an array column."""
    return items.select(F.explode(column).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


@dataclass(frozen=True)
class AuditRule:
    """A pattern that shows that a brand's name means something else."""

    brand: str
    pattern: str
    reason: str


def audited(articles: DataFrame, rules: Sequence[AuditRule], title: str = "title", content: str = "full_content", brands: str = "brands_mentioned", head: int = 2_000) -> DataFrame:
    """Articles that a rule of one of their brands finds, in the title or the content's first ``head`` characters: brand, pattern and
    reason of the first such rule, in the order given; each article once."""
    text = F.concat_ws("\n", F.col(title), F.substring(F.coalesce(F.col(content), F.lit("")), 1, head))
    found = F.array(*[F.when(F.array_contains(brands, r.brand) & text.rlike(f"(?i){r.pattern}"), F.struct(F.lit(r.brand).alias("brand"), F.lit(r.pattern).alias("pattern"), F.lit(r.reason).alias("reason"))) for r in rules])
    first = F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 1)
    # an outer generator, as a filter on the hit would be pushed down to the scan with all that brands are made of written out for each rule
    hit = articles.select(*articles.columns, F.inline_outer(first).alias("audit_brand", "audit_pattern", "audit_reason"))
    return hit.filter("audit_brand is not null")


def rebranded(articles: DataFrame, found: Column, brands: str = "brands_mentioned") -> tuple[DataFrame, DataFrame]:
    """Articles whose set of brands is another one now (with it), and those that have none left."""
    now = articles.withColumn("_now", F.sort_array(F.array_distinct(found)))
    changed = now.filter(F.col("_now") != F.sort_array(F.array_distinct(F.coalesce(brands, F.array().cast("array<string>"))))).withColumn(brands, F.col("_now")).drop("_now")
    return changed.filter(F.size(brands) > 0), changed.filter(F.size(brands) == 0)


def rechunked(articles: DataFrame, evidence: DataFrame, least: float = 0.5, **options) -> tuple[DataFrame, DataFrame]:
    """New chunks of articles (id, full_content) and the evidence (id, article_id, excerpt, chunk_id, relevance_score) with its new links; evidence that matches no
    new chunk keeps its score and has no link."""
    made = articles.select(F.col("id").alias("article_id"), F.explode(chunks(F.col("full_content"), **options)).alias("c"))
    made = made.select(F.concat_ws("-", "article_id", "c.index").alias("chunk_id"), "article_id", F.col("c.index").alias("chunk_index"), F.col("c.text").alias("chunk_text"), "c.char_start", "c.char_end", "c.token_count")
    nothing = F.lit(None).cast("array<double>").alias("embedding")
    best = matched(evidence.select(F.col("id").alias("excerpt_id"), "article_id", "excerpt", nothing), made.select("*", nothing), least)
    linked = evidence.drop("chunk_id").join(best.select(F.col("excerpt_id").alias("id"), "chunk_id", "similarity"), "id", "left")
    return made, linked.withColumn("relevance_score", F.when(F.col("chunk_id").isNotNull(), F.col("similarity")).otherwise(F.col("relevance_score"))).drop("similarity")


def to_rechunk(articles: DataFrame, labels: DataFrame, evidence: DataFrame, chunks: DataFrame, only: Sequence | None = None) -> DataFrame:
    """Labelled articles (or those of the ids given) with what a new cut would touch: n_labels, n_evidence, n_chunks (which would be deleted), n_dangling (evidence linked to a
    chunk that isn't there) and needed: it has no chunks, or dangling evidence. Children are counted before they meet their article.
    articles: id, labeling_status; labels: id, article_id; evidence: article_id, chunk_id; chunks: id, article_id."""
    listed = articles.filter("labeling_status = 'labeled'").select("id")
    listed = listed if only is None else listed.filter(F.col("id").isin(list(only)))
    count = lambda df, name: df.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias(name))
    linked = evidence.filter("chunk_id IS NOT NULL").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    out = listed
    for df, name in ((labels, "n_labels"), (evidence, "n_evidence"), (chunks, "n_chunks"), (linked, "n_dangling")):
        out = out.join(count(df, name), "id", "left")
    out = out.select("id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_labels", "n_evidence", "n_chunks", "n_dangling")])
    return out.withColumn("needed", (F.col("n_chunks") == 0) | (F.col("n_dangling") > 0))


def without_chunks(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """chunks without those of the articles (id)."""
    return chunks.join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_anti")
