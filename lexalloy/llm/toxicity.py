"""Toxicity (operator 8): a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length.

Folding (native): letters are lower-cased, look-alike letters of other scripts and full-width forms become Latin ones,
digits and signs that stand for letters inside a word become these letters, and i, l and 1 become one letter, as nobody
can tell them apart.

Learning: words of labelled texts (folded) get the log-odds of label 1; stems (beginnings of words) too, so that new
endings of a known stem are matched. What counts are contexts (a word and the one behind it), each once, so that many
near copies of one text say no more than the text. Entries need a number of contexts, from several texts, and a precision; an entry inside a
chosen shorter one is left out. Words of clean texts that hold a chosen stem become exception phrases; more can be given. A
match inside an exception doesn't count. The score is a logistic function of the matched weight per square root of the
text's words, fitted on the same labelled texts. A bounded sample of labelled rows (``max_rows``) is used for this;
matching covers every whole text.

Defined results: a null or empty text matches nothing and gets the score of no match; repeated rows are scored each;
an id with both labels counts as label 1;
without labels of both kinds the lexicon is empty and every score is the share of ones (0 without labels); an empty table
gives an empty table; a very long text is matched whole, in time linear in its length but for the sorting of its matches;
further columns pass through, and score and predicted replace columns of these names. The lexicon holds words of the
labelled sample alone, which ``max_rows`` bounds; beyond that nothing limits its entries or exceptions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, dropped, let, stored

#: Look-alikes and the letters that they stand for.
_LOOK_ALIKES = {
    "a": "аαａ", "b": "ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іıιｉl1ｌӏ", "j": "јｊ", "k": "кκｋ", "m": "мｍ",
    "n": "ոｎ", "o": "оοσｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5", "t": "тτｔ7", "u": "υսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ", "3": "３",
}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "3": "e", "4": "a", "8": "b"}
_FROM, _TO = "".join(v for v in _LOOK_ALIKES.values()), "".join(k * len(v) for k, v in _LOOK_ALIKES.items())
_NOT_LETTERS = r"[^\p{L}\p{M}]+"


def folded(text: Column) -> Column:
    """Lower-case letters; signs become letters only between letters, so that punctuation at a word's end stays."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO)
    return F.when(out.rlike(r"\p{L}[@$!|348]+\p{L}"), _between(out)).otherwise(out)


def _between(out: Column) -> Column:
    """Each sign between letters, one kind at a time."""
    for sign, letter in _SIGNS.items():
        out = F.regexp_replace(out, rf"(?<=\p{{L}})[{sign}](?=[\p{{L}}@$!|348])", letter)
    return out


def contexts_of(text: Column) -> Column:
    """The distinct pairs (w, behind) of neighbouring words of a folded text."""
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))))
    distinct = F.array_distinct(let(F.filter(F.split(text, _NOT_LETTERS), lambda w: w != ""), pairs))  # of strings, which are hashed
    return F.transform(distinct, lambda p: F.struct(F.substring_index(p, " ", 1).alias("w"), F.substring_index(p, " ", -1).alias("behind")))


@dataclass(frozen=True)
class Lexicon:
    """entries: text to weight, a full word, or a stem where stems has it. exceptions: phrases in which matches don't count."""

    entries: dict[str, float]
    stems: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    offset: float = 0.0

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e in [*self.entries, *self.exceptions]:
            found.add_word(e, e)
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def matched(self, text: str) -> float:
        """The weight of the longest matches that don't overlap, at word beginnings, outside exceptions."""
        spans, excepted = [], []
        for end, entry in self.automaton.iter(text):
            start = end + 1 - len(entry)
            if start and text[start - 1].isalpha():
                continue
            closed = end + 1 == len(text) or not text[end + 1].isalpha()
            if entry in self.exceptions and closed:
                excepted.append((start, end))
            if entry in self.entries and (closed or entry in self.stems):
                spans.append((start, -end, self.entries[entry]))
        total, last, furthest, at = 0.0, -1, -1, 0
        excepted.sort()
        for start, negative_end, weight in sorted(spans):
            while at < len(excepted) and excepted[at][0] <= start:
                furthest, at = max(furthest, excepted[at][1]), at + 1
            if start > last and -negative_end > furthest:  # no exception begins here or before and ends here or behind
                total, last = total + weight, -negative_end
        return total

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * normalised(total, words) + self.offset)))


def normalised(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(total / np.sqrt(np.maximum(words, 1.0)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge-regularised logistic regression on one variable, by Newton's method."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def learned(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, min_contexts: int = 5, min_texts: int = 3, min_precision: float = 0.8, stem_sizes: tuple[int, int] = (4, 8), exceptions: tuple[str, ...] = ()) -> Lexicon:
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter(learn).distinct()
    sample = docs.select(id_col, folded(F.col(text_col)).alias("f")).join(bounded_sample(known, id_col, max_rows), id_col)
    sample = sample.groupBy(id_col, "y").agg(F.min("f").alias("f"))  # one text an id, so that a repeated id doesn't exceed the bound
    # copies of a text say what one says: each distinct text counts once
    texts = stored(sample.groupBy(F.xxhash64("f").alias("h")).agg(F.first("f").alias("f"), F.max("y").alias("y")), "toxicity")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, ones = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not ones or ones == n:
        share = min(max(ones / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Lexicon({}, offset=math.log(share / (1 - share)))
    contexts = texts.repartition(tasks).select("y", "h", F.inline(contexts_of(F.col("f")))).groupBy("w", "behind").agg(F.min("y").alias("y"), F.min("h").alias("h"))
    by_word = stored(contexts.groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("y") == 1, F.col("h"))).alias("texts")), "words")
    n, ones = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    size = F.explode(F.sequence(F.lit(stem_sizes[0]), F.lit(stem_sizes[1]))).alias("k")
    stems = by_word.filter(F.length("w") > stem_sizes[0]).select("w", "t", "n", "texts", size).filter(F.col("k") < F.length("w")).groupBy(F.substring(F.col("w"), F.lit(1), F.col("k")).alias("w")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.count("*").alias("forms"))
    good = (F.col("t") >= min_contexts) & (F.col("texts") >= min_texts) & (F.col("t") >= min_precision * F.col("n"))
    weight = F.log((F.col("t") + 0.5) / (ones + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - ones + 1))
    both = by_word.select("w", "t", "n", "texts", F.lit(0).cast("long").alias("forms")).unionByName(stems.filter("forms > 1")).filter(good)
    chosen = both.withColumn("weight", weight).collect()  # words of the sample, which max_rows bounds
    stem_weights = {r.w: r.weight for r in chosen if r.forms}
    stem_weights = {w: v for w, v in stem_weights.items() if not any(w[:k] in stem_weights for k in range(stem_sizes[0], len(w)))}
    inside = lambda w: any(w[:k] in stem_weights for k in range(stem_sizes[0], len(w) + 1))
    entries = {r.w: r.weight for r in chosen if not r.forms and not inside(r.w)} | stem_weights
    excepted = under_stems(by_word.filter("t = 0").select("w"), sorted(stem_weights), stem_sizes) if stem_weights else []
    dropped(by_word)
    lexicon = Lexicon(entries, frozenset(stem_weights), frozenset([*excepted, *exceptions]) - entries.keys())
    measured = texts.select("y", matches(F.col("f"), lexicon).alias("m")).select("y", "m.*").collect()
    y, total, words = (np.array([r[k] for r in measured], dtype=np.float64) for k in ("y", "total", "words"))
    slope, offset = _logistic(normalised(total, words), y)
    dropped(texts)
    return Lexicon(lexicon.entries, lexicon.stems, lexicon.exceptions, slope, offset)


def under_stems(words: DataFrame, stems: list[str], stem_sizes: tuple[int, int]) -> list[str]:
    """The words that begin with a stem: their beginnings are joined with the stems, however many there are."""
    known = words.sparkSession.createDataFrame([(s,) for s in stems], "beginning string")
    sizes = F.filter(F.sequence(F.lit(stem_sizes[0]), F.lit(stem_sizes[1])), lambda k: k <= F.length("w"))
    beginnings = words.select("w", F.explode(F.transform(sizes, lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("beginning"))
    return [r.w for r in beginnings.join(known, "beginning", "left_semi").select("w").distinct().collect()]


def matches(text: Column, lexicon: Lexicon) -> Column:
    """total (matched weight) and words of a folded text."""

    @F.pandas_udf(T.StructType([T.StructField("total", T.DoubleType()), T.StructField("words", T.LongType())]))
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"total": [lexicon.matched(t) if lexicon.entries else 0.0 for t in part], "words": [len(t.split()) for t in part]})

    return match(text)


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (they replace columns of these names)."""

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(lexicon.score(part["total"].to_numpy(), part["words"].to_numpy()))

    out = docs.withColumn("score", score(matches(folded(F.col(text_col)), lexicon)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
