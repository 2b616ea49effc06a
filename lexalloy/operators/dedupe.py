"""Title deduplication: exact (first of id, then of title) and near (ratio of a sequence matcher, greedy in order)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def normalised(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", " "))


def first_of_each(articles: DataFrame, order: str, id_col: str = "article_id", title_col: str = "title") -> DataFrame:
    """articles with duplicate: 'id', 'title' or null. Blank titles never are duplicates."""
    seen = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    marked = articles.withColumn("_copy", seen > 1)
    key = F.when(normalised(F.col(title_col)) == "", F.concat(F.lit("#"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("t"), normalised(F.col(title_col))))
    place = F.row_number().over(Window.partitionBy(key, "_copy").orderBy(order))
    return marked.withColumn("duplicate", F.when(F.col("_copy"), F.lit("id")).when(place > 1, F.lit("title"))).drop("_copy")


@F.pandas_udf(T.DoubleType())
def ratio(new: pd.Series, seen: pd.Series) -> pd.Series:
    """The matcher isn't symmetric: the newer title is the first argument."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(new, seen, strict=True)])


def near_pairs(articles: DataFrame, order: str, title_col: str = "title", threshold: float = 0.9) -> DataFrame:
    """(later, earlier, ratio) of distinct titles at least threshold alike, in a batch of titles (titles as alike as their
    triples: candidates are what the rule itself compares). A ratio 2m / (a + b) >= t bounds the lengths (2 min / (a + b) >= t) and
    the unmatched characters of both, each of which costs at most three character triples: two such titles share one of the
    rarest of their triples, as many as can be lost and one more, rarest first in the batch."""
    titles = articles.select(F.col(order).alias("o"), normalised(F.col(title_col)).alias("t")).filter("t <> ''").groupBy("t").agg(F.min("o").alias("o"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substring("t", i, F.lit(3))))
    exploded = titles.select("o", "t", F.explode(grams).alias("g"))
    counted = exploded.join(exploded.groupBy("g").agg(F.count("*").alias("df")), "g")
    keyed = counted.groupBy("o", "t").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("grams"))
    lost = F.ceil(F.length("t") * (3 * 2 * (1 - threshold) / threshold)).cast("int") + 1
    probes = keyed.withColumn("probe", F.explode(F.slice("grams", F.lit(1), lost))).select("o", "t", F.col("probe.g").alias("g"))
    a, b = probes.alias("a"), probes.alias("b")
    size = 2 * F.least(F.length("a.t"), F.length("b.t")) >= threshold * (F.length("a.t") + F.length("b.t"))
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.o") > F.col("b.o")) & size).select(F.col("a.o").alias("later"), F.col("b.o").alias("earlier"), F.col("a.t").alias("new"), F.col("b.t").alias("seen")).distinct()
    return pairs.withColumn("ratio", ratio("new", "seen")).filter(F.col("ratio") >= threshold).select("later", "earlier", "ratio")


def greedy(pairs: DataFrame) -> DataFrame:
    """Which of the later titles go: those that are near a kept earlier one. A title is decided once all its earlier neighbours are; rounds of joins."""
    from ..sources.files import checkpoint_dir

    checkpoint_dir(pairs.sparkSession)
    edges = pairs.select("later", "earlier").distinct().checkpoint()
    nodes = edges.select(F.col("later").alias("o")).union(edges.select(F.col("earlier").alias("o"))).distinct()
    state = nodes.join(edges.select(F.col("later").alias("o")).distinct().withColumn("waits", F.lit(True)), "o", "left").select("o", F.when(F.col("waits").isNull(), F.lit(True)).alias("kept")).checkpoint()
    while not state.filter("kept is null").isEmpty():  # each round decides at least the earliest of those left
        around = edges.join(state.select(F.col("o").alias("earlier"), "kept"), "earlier").groupBy("later").agg(F.bool_or("kept").alias("any_kept"), F.count_if(F.col("kept").isNull()).alias("open"))
        decided = F.when(F.col("any_kept"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        state = state.join(around.withColumnRenamed("later", "o"), "o", "left").select("o", F.coalesce("kept", decided).alias("kept")).checkpoint()
    return state.filter(~F.col("kept")).select(F.col("o").alias("dropped"))


