"""Evidence to chunks, near-duplicate titles, chunking: what needs a sequence matcher or running offsets runs in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import cosine
from ..sources.files import checkpoint_dir

CHUNK = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("token_count", T.IntegerType())]))
_TOKEN, _SENTENCE = re.compile(r"\w+|[^\w\s]"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def count_tokens(text: str) -> int:
    """The default counter: words and punctuation marks."""
    return len(_TOKEN.findall(text))


def _parts(text: str, gap: re.Pattern, base: int) -> Iterator[tuple[str, int, int]]:
    at = 0
    for m in [*gap.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end].strip()
        if piece:
            begin = text.index(piece, at)
            yield piece, base + begin, base + begin + len(piece)
        at = m.end() if m else end


def chunk_text(text: str | None, target: int = 200, most: int = 350, least: int = 75, counter: Callable[[str], int] = count_tokens, paragraph: str = r"\n\s*\n") -> list[tuple[int, str, int, int, int]]:
    """Chunks of paragraphs of about target tokens: paragraphs over ``most`` are split at sentences, pieces are joined while
    they fit the target, one under ``least`` joins the one before. Offsets are those of the stripped text."""
    text = (text or "").strip()
    if not text:
        return []
    if counter(text) <= int(0.75 * target):
        return [(0, text, 0, len(text), counter(text))]
    pieces: list[tuple[str, int, int, int]] = []
    for body, begin, end in _parts(text, re.compile(paragraph), 0):
        size = counter(body)
        if size <= most:
            pieces.append((body, begin, end, size))
            continue
        held: list[tuple[str, int, int, int]] = []
        for sentence in _parts(body, _SENTENCE, begin):
            n = counter(sentence[0])
            if held and sum(h[3] for h in held) + n > target:
                pieces.append((" ".join(h[0] for h in held), held[0][1], held[-1][2], sum(h[3] for h in held)))
                held = []
            held.append((*sentence, n))
        pieces.append((" ".join(h[0] for h in held), held[0][1], held[-1][2], sum(h[3] for h in held)))
    merged: list[tuple[str, int, int, int]] = []
    for piece in pieces:
        if merged and (merged[-1][3] + piece[3] <= target or piece[3] < least):
            last = merged[-1]
            merged[-1] = (f"{last[0]}\n\n{piece[0]}", last[1], piece[2], last[3] + piece[3])
        else:
            merged.append(piece)
    return [(i, body, begin, end, counter(body)) for i, (body, begin, end, _) in enumerate(merged)]


def chunks(text: Column, **options) -> Column:
    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("index", "text", "char_start", "char_end", "token_count"), c, strict=True)) for c in chunk_text(t, **options)] for t in texts])

    return run(text)


def compared(excerpt: Column, text: Column) -> Column:
    """The parts of the text that an excerpt is held against: all of it for excerpts up to 100 characters, else windows of twice the
    excerpt's length, a quarter of it apart; none where the excerpt is empty or over half as long again as the text."""
    n, m = F.length(excerpt), F.length(text)
    size = F.least(2 * n, m)
    begins = F.sequence(F.lit(1), m - size + 1, F.greatest(F.floor(n / 4), F.lit(1)).cast("int"))
    windows = F.transform(begins, lambda b: F.substring(text, b, size))
    return F.when(m.isNull() | (n == 0) | (n > 1.5 * m), F.array().cast("array<string>")).when(n <= 100, F.array(text)).otherwise(windows)


def best_ratio(excerpt: str, parts: Sequence[str]) -> float:
    """The greatest ratio of the excerpt and a part. A ratio can't exceed what both have of the same characters: parts are taken by
    that bound, and those that can't beat the best so far aren't aligned."""
    own = Counter(excerpt)
    bounds = sorted(((2 * (own & Counter(p)).total() / max(len(excerpt) + len(p), 1), i) for i, p in enumerate(parts)), key=lambda x: (-x[0], x[1]))
    best = 0.0
    for bound, i in bounds:
        if bound <= best:
            break
        best = max(best, SequenceMatcher(None, excerpt, parts[i]).ratio())
    return best


@F.pandas_udf(T.DoubleType())
def _best_ratio(excerpts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([0.0 if e is None or p is None else best_ratio(e, p) for e, p in zip(excerpts, parts, strict=True)])


def fuzzy(excerpt: Column, text: Column) -> Column:
    """The best ratio of the excerpt (white space at its ends aside) against the text's parts, in lower case; 0 for null."""
    e, t = F.lower(F.regexp_replace(excerpt, r"(?U)^\s+|\s+$", "")), F.lower(text)
    return _best_ratio(e, compared(e, t))


def matched(excerpts: DataFrame, parts: DataFrame, least: float = 0.5) -> DataFrame:
    """For each excerpt (excerpt_id, article_id, excerpt, embedding or null) its best chunk (chunk_id, article_id, chunk_index, chunk_text,
    embedding): chunk_id, similarity, method. An exact hit wins; else 0.3 fuzzy and 0.7 cosine with embeddings, else fuzzy; under least: none."""
    e, c = excerpts.alias("e"), parts.alias("c")
    pairs = e.join(c, F.col("e.article_id") == F.col("c.article_id"), "left")
    exact = F.contains(F.col("c.chunk_text"), F.regexp_replace(F.col("e.excerpt"), r"(?U)^\s+|\s+$", ""))
    both = F.col("e.embedding").isNotNull() & F.col("c.embedding").isNotNull()
    pairs = pairs.select("e.excerpt_id", "e.excerpt", "c.chunk_id", "c.chunk_index", "c.chunk_text", F.coalesce(exact, F.lit(False)).alias("exact"), F.when(both, cosine(F.col("e.embedding"), F.col("c.embedding"))).alias("cosine"))
    near = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("fuzzy"))
    settled = F.max("exact").over(Window.partitionBy("excerpt_id"))  # where a chunk holds the excerpt, no other one is compared
    scored = pairs.withColumn("_settled", settled).filter(F.col("exact") | ~F.col("_settled")).drop("_settled").withColumn("fuzzy", fuzzy(F.when(~F.col("exact"), F.col("excerpt")), F.col("chunk_text")))
    score = F.when(F.col("exact"), F.lit(1.0)).when(F.col("cosine").isNotNull(), 0.3 * near + 0.7 * F.col("cosine")).otherwise(F.coalesce(near, F.lit(0.0)))
    method = F.when(F.col("exact"), F.lit("exact")).when(F.col("cosine").isNotNull(), F.lit("combined")).otherwise(F.lit("fuzzy"))
    rank = F.struct(F.col("exact"), F.when(F.col("exact"), F.lit(1.0)).otherwise(score).alias("score"), (-F.coalesce("chunk_index", F.lit(0))).alias("place"))
    best = scored.groupBy("excerpt_id").agg(F.max_by(F.struct("chunk_id", score.alias("score"), method.alias("method")), rank).alias("b"))
    weak = F.coalesce(F.col("b.score"), F.lit(0.0)) < least
    return best.select("excerpt_id", F.when(~weak, F.col("b.chunk_id")).alias("chunk_id"), F.coalesce("b.score", F.lit(0.0)).alias("similarity"), F.when(weak, F.lit("none")).otherwise(F.col("b.method")).alias("method"))


def exact_matches(excerpts: DataFrame, parts: DataFrame) -> DataFrame:
    """excerpt_id, chunk_id of the first chunk of its article that holds the excerpt (outer white space aside): the first stage of
    ``matched``, without any fuzzy work."""
    trimmed = F.regexp_replace(F.col("e.excerpt"), r"(?U)^\s+|\s+$", "")
    pairs = excerpts.alias("e").join(parts.alias("c"), (F.col("e.article_id") == F.col("c.article_id")) & F.contains(F.col("c.chunk_text"), trimmed))
    return pairs.groupBy("e.excerpt_id").agg(F.min_by("c.chunk_id", "c.chunk_index").alias("chunk_id"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, max_queries: int = 4_000) -> DataFrame:
    """The k most cosine-similar vectors of each query vector: query, neighbour, similarity; ties go to the lesser id, a vector
    without length or of another size has similarity 0.

    A block of at most about ``max_queries`` queries is broadcast as one matrix; each task multiplies its vectors with it
    and passes on only the k best of each query, so that what is shuffled is queries times tasks, not queries times
    vectors. More queries run in blocks by a hash of the id, each block's result written before the next one."""
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).alias("qv"))
    found = vectors.select(F.col(id_col).cast("long").alias("neighbour"), F.col(vector_col).alias("v"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    spark = queries.sparkSession

    def of(block: DataFrame) -> DataFrame:
        rows = block.collect()
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r.qv or ()) for r in rows}:
            mine = [r for r in rows if len(r.qv or ()) == size]
            by_size[size] = np.array([r["query"] for r in mine], np.int64), _unit(np.array([r.qv or () for r in mine], np.float64).reshape(len(mine), size))
        shared = spark.sparkContext.broadcast(by_size)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = {s: (np.full((len(q), 0), 0, np.int64), np.full((len(q), 0), 0.0)) for s, (q, _) in shared.value.items()}
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.iloc[at : at + 1024]
                    ids, values = part["neighbour"].to_numpy(np.int64), list(part["v"])
                    for size, (own, matrix) in shared.value.items():
                        fits = np.array([x is not None and len(x) == size for x in values], bool)
                        similarity = np.zeros((len(own), len(ids)))
                        if size and fits.any():
                            similarity[:, fits] = matrix @ _unit(np.array([x for x, f in zip(values, fits, strict=True) if f], np.float64)).T
                        similarity[own[:, None] == ids[None, :]] = -np.inf
                        names, scores = top[size]
                        names, scores = np.hstack([names, np.broadcast_to(ids, similarity.shape)]), np.hstack([scores, similarity])
                        order = np.lexsort((names, -scores), axis=1)[:, :k]
                        top[size] = np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)
            for size, (names, scores) in top.items():
                out = pd.DataFrame({"query": np.repeat(shared.value[size][0], names.shape[1]), "neighbour": names.ravel(), "similarity": scores.ravel()})
                yield out[np.isfinite(out["similarity"])]

        ranked = found.mapInPandas(best, "query long, neighbour long, similarity double")
        return ranked.withColumn("place", place).filter(F.col("place") <= k)

    n = asked.count()
    if n <= max_queries:
        return of(asked)
    checkpoint_dir(spark)
    blocks = -(-2 * n // max_queries)
    return reduce(DataFrame.union, [of(asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).checkpoint() for b in range(blocks)])


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def nested(labels: DataFrame, matches: DataFrame, article: str = "article_id", columns: Sequence[str] = ("excerpt_id", "chunk_id", "similarity")) -> DataFrame:
    """(article, brands): for each article a map of brand to a map of category to its matches (structs of ``columns``, in their order), of those
    labels only that apply and have evidence. labels: article, brand, category, applies; matches: article, brand, category and ``columns``, a row an excerpt.
    Repeated labels count once; articles without such a label have no row. An article's row holds its own matches: as many as its
    labels have excerpts."""
    keys = [article, "brand", "category"]
    applied = labels.filter("applies").select(*keys).distinct()
    found = matches.join(applied, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("matches"))
    by_brand = found.groupBy(article, "brand").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "matches")))).alias("categories"))
    return by_brand.groupBy(article).agg(F.map_from_entries(F.collect_list(F.struct("brand", "categories"))).alias("brands"))
