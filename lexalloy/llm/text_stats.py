"""Statistics of whole texts as native columns, shared by the quality rules (7) and the quality classifier (10).

A null text counts as empty: all statistics are 0. Texts of any length are taken whole; a row's work is n log n in
its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed: what separates words, and which characters count as symbols.
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def count_chars(text: Column, others: str) -> Column:
    """How many characters are left when ``others`` (a pattern) goes."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def repeated_positions(hashes: Column, window: int = 3) -> Column:
    """How many words stand in a window of that many consecutive words which the text holds twice or more. hashes: 64-bit, one a word."""
    def grams(h: Column) -> Column:
        starts = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window))
        return F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(window)]).alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k).h == x.h, F.lit(False))
        found = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(found, lambda x: x.i))

    def spread(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return F.coalesce(let(let(hashes, grams), lambda g: let(repeated(g), spread)), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (without its text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.withColumn("_w", words_of(F.col(text_col)))
    hashed = words.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": count_chars(text, WHITE),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": duplicate_lines(F.col(text_col)),
        "n_repeat_words": repeated_positions(F.transform("_w", lambda w: F.xxhash64(w))),
    })
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return hashed.withColumn("base_failed", failed)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Statistics that both models may look at, as shares: what a text's size doesn't change.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "bang_share", "pipe_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "adjacent_share", "line_words", "stop_share", "comma_share")


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base statistics, the FEATURES (doubles), and without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_statistics(docs, text_col).withColumns({
        "_distinct": F.size(F.array_distinct("_w")),
        "_adjacent": F.size(F.filter(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, greatest(size(_w) - 1, 0))").alias("b")), lambda x: x.a == x.b)),
        "_short": F.size(F.filter("_w", lambda w: F.length(w) <= 3)),
        "_upper": count_chars(text, r"[^\p{Lu}]+"),
        "_bang": count_chars(text, "[^!]+"),
        "_pipe": count_chars(text, "[^|]+"),
        "_digit": count_chars(text, "[^0-9]+"),
        "_comma": count_chars(text, "[^,]+"),
        "_lines": count_chars(text, "[^\n]+") + 1,
    })
    n, c = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = {
        "mean_word": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / c, "upper_share": F.col("_upper") / c, "bang_share": F.col("_bang") / c,
        "pipe_share": F.col("_pipe") / n, "digit_share": F.col("_digit") / c, "dup_line_share": F.col("n_dup_lines") / F.col("_lines"), "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("_distinct") / n, "adjacent_share": F.col("_adjacent") / n, "line_words": F.col("n_words") / F.col("_lines"), "stop_share": F.col("_short") / n,
        "comma_share": F.col("_comma") / n,
    }
    plain = [c for c in docs.columns if c != text_col and c not in BASE and c not in FEATURES] + list(BASE)
    return base.select(*plain, *[v.cast("double").alias(k) for k, v in shares.items()])
