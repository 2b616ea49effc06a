"""Language identification (operator 5): multilingual mixture inference.

Learning: character n-grams (3 code points, letters lower-cased, runs of other characters as one space) are hashed into
``buckets``; their counts by language are summed by Spark over a bounded sample of labelled texts and smoothed into
log-likelihoods. The model has a number for each n-gram bucket that a language's sample holds; the sample bounds it, not a number of languages.

Inference, vectorised over a batch of whole texts: expectation-maximisation estimates the proportions of all languages
in a text from its n-grams' likelihoods; the languages, ordered by proportion, give nested sets (an approximation: not all
sets of languages are tried, and the search ends with the first larger set that doesn't pay); each set is refitted and the one with the best log-likelihood less ``penalty`` per language and half the logarithm of the n-grams (as in
the Bayesian information criterion) is selected. The first language of that set is the prediction, its proportion the score.

Defined results: a null text, an empty one, and one without a letter get ``und``, score 0 and no languages; repeated
rows are judged each; without labelled texts all others get ``und`` too; an empty table gives an empty table; a very long text is inferred whole, in
a block of its own; extra columns pass through, those of the result's
names are replaced.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample

#: Numbers that a word may hold and that aren't decimal digits (fractions, superscripts, Roman numerals): no letters. They are rare, so
#: texts are searched for them first, and the expressions needn't name them.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_SPACES = str.maketrans(dict.fromkeys(_NUMBERS, " "))
_WORDLY = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
#: Code points of a text worked on at once.
_BLOCK = 1 << 20


def hashed_grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of each text (between two spaces): the text's place and the n-gram's bucket."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(31)
    bucket = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % buckets
    inside = owner[:-2] == owner[2:]
    return owner[:-2][inside], bucket[inside]


def has_letter(text: str) -> bool:
    found = _WORDLY.search(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text)))


def normal_form(text: str) -> str:
    low = text.lower()
    if not low.isascii() and not _NUMBERS.isdisjoint(low):
        low = low.translate(_SPACES)
    return f" {_OTHER.sub(' ', low).strip()} "


@dataclass(frozen=True)
class Sparse:
    """Log-likelihoods of n-grams where languages are many: ``values`` of the ``cells`` (bucket * languages + language, rising) that
    a sample holds, and ``rest``, a language's for all other buckets. Laid out a page of languages at a time."""

    cells: np.ndarray
    values: np.ndarray
    rest: np.ndarray
    buckets: int
    page: int = 64

    def columns(self, lo: int, hi: int) -> np.ndarray:
        """buckets x languages lo to hi."""
        out = np.tile(self.rest[lo:hi], (self.buckets, 1))
        bucket, lang = self.cells // len(self.rest), self.cells % len(self.rest)
        here = (lang >= lo) & (lang < hi)
        out[bucket[here], lang[here] - lo] = self.values[here]
        return out

    def chosen(self, bucket: np.ndarray, langs: np.ndarray) -> np.ndarray:
        cell = bucket[:, None] * len(self.rest) + langs
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.values[at], self.rest[langs])


@dataclass(frozen=True)
class Model:
    """Either a matrix of log-likelihoods (buckets x languages) or, for many languages, a sparse one. No bound on languages."""

    languages: tuple[str, ...]
    log_likelihood: np.ndarray | None
    sparse: Sparse | None = None

    @property
    def buckets(self) -> int:
        return len(self.log_likelihood) if self.sparse is None else self.sparse.buckets

    def pages(self, bucket: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Log-likelihoods of the buckets, a page of languages at a time."""
        if self.sparse is None:
            yield 0, len(self.languages), self.log_likelihood[bucket]
            return
        for lo in range(0, len(self.languages), self.sparse.page):
            hi = min(lo + self.sparse.page, len(self.languages))
            yield lo, hi, self.sparse.columns(lo, hi)[bucket]

    def chosen(self, bucket: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Log-likelihoods of each bucket in the languages of its row of langs."""
        return self.log_likelihood[bucket[:, None], langs] if self.sparse is None else self.sparse.chosen(bucket, langs)

    def infer(self, texts: list[str | None], penalty: float, steps: int) -> list[tuple[str, float, list[str], list[float]]]:
        """For each text: language, its proportion, the selected languages and their proportions."""
        out: list = [("und", 0.0, [], [])] * len(texts)
        if not self.languages:
            return out
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        most = max(1, (1 << 22) // len(self.languages))  # texts x languages
        block, size = [], 0
        for i in known:
            block.append(i)
            size += len(texts[i])
            if size >= _BLOCK or len(block) >= most:
                self._infer(texts, block, out, penalty, steps)
                block, size = [], 0
        if block:
            self._infer(texts, block, out, penalty, steps)
        return out

    def _infer(self, texts: list, block: list[int], out: list, penalty: float, steps: int) -> None:
        owner, bucket = hashed_grams([normal_form(texts[i]) for i in block], self.buckets)
        cell, count = np.unique(owner * self.buckets + bucket, return_counts=True)
        doc, bucket, count = cell // self.buckets, cell % self.buckets, count.astype(np.float64)
        here, first = np.unique(doc, return_index=True)
        doc = np.searchsorted(here, doc)
        total = np.add.reduceat(count, first)
        order = np.argsort(-self._everything(doc, bucket, count, first, total, steps), axis=1, kind="stable")
        best, kept = np.full(len(here), -np.inf), np.zeros(len(here), np.int64)
        proportions: list[np.ndarray] = [np.zeros(0)] * len(here)
        going = np.arange(len(here))  # texts whose last set paid; only their n-grams are worked on
        for k in range(1, order.shape[1] + 1):
            found = self.chosen(bucket, order[doc, :k])
            top = found.max(axis=1)
            likelihood = np.exp(found - top[:, None])
            p = np.full((len(going), k), 1 / k)
            place = np.repeat(np.arange(len(going)), np.diff([*first, len(doc)]))
            for _ in range(steps if k > 1 else 0):
                share = p[place] * likelihood
                p = np.add.reduceat(share * (count / np.maximum(share.sum(axis=1), 1e-300))[:, None], first) / total[going, None]
            mixture = np.maximum((p[place] * likelihood).sum(axis=1), 1e-300)
            value = np.add.reduceat(count * (np.log(mixture) + top), first) - penalty * k * (1 + 0.5 * np.log(total[going]))
            better = value > best[going]
            for i in np.flatnonzero(better).tolist():
                proportions[going[i]] = p[i]
            best[going[better]], kept[going[better]] = value[better], k
            if not better.any():
                break
            stay = better[place]
            going, doc, bucket, count = going[better], doc[stay], bucket[stay], count[stay]
            first = np.unique(doc, return_index=True)[1]
        for i, d in enumerate(here.tolist()):
            ranked = sorted(((float(v), self.languages[j]) for v, j in zip(proportions[i], order[i, : kept[i]].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))
            out[block[d]] = (ranked[0][1], min(max(ranked[0][0], 0.0), 1.0), [n for _, n in ranked], [p for p, _ in ranked])

    def _everything(self, doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, first: np.ndarray, total: np.ndarray, steps: int) -> np.ndarray:
        """Proportions of all languages by EM, from even ones."""
        width, once = len(self.languages), self.sparse is None
        p = np.full((len(total), width), 1 / width)
        top = np.full(len(doc), -np.inf)
        for _, _, found in self.pages(bucket):
            np.maximum(top, found.max(axis=1), out=top)
        parts = lambda: ((lo, hi, np.exp(found - top[:, None])) for lo, hi, found in self.pages(bucket))
        held = list(parts()) if once else None
        for _ in range(steps):
            mixture = sum((p[doc, lo:hi] * likelihood).sum(axis=1) for lo, hi, likelihood in held or parts())
            weight = count / np.maximum(mixture, 1e-300)
            for lo, hi, likelihood in held or parts():
                p[:, lo:hi] = np.add.reduceat(p[doc, lo:hi] * likelihood * weight[:, None], first) / total[:, None]
        return p


def learned(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, buckets: int = 1 << 15, smoothing: float = 0.05, dense: int = 64) -> Model:
    """learn: says of a row whether it may be learned from; rows with a null language or text are left out. Up to ``dense`` languages
    the model is a matrix; results don't depend on it."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).filter(learn)
    sample = bounded_sample(known.select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), id_col, max_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts, size = [], 0
                for t in [*part["text"], None]:
                    if t is not None:
                        texts.append(normal_form(t))
                        size += len(t)
                    if texts and (t is None or size >= _BLOCK):
                        found = np.bincount(hashed_grams(texts, buckets)[1], minlength=buckets)
                        sums[lang] = sums.get(lang, 0) + found
                        texts, size = [], 0
        for lang, found in sums.items():
            used = np.flatnonzero(found)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": found[used]})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # columns, not objects: at most buckets x languages numbers
    languages = tuple(sorted(counted["lang"].unique()))
    place = {x: i for i, x in enumerate(languages)}
    lang, n = np.array([place[x] for x in counted["lang"]], dtype=np.int64), counted["n"].to_numpy(np.float64)
    if len(languages) <= dense:
        counts = np.zeros((buckets, len(languages)))
        counts[counted["bucket"].to_numpy(np.int64), lang] = n
        smooth = counts + smoothing
        return Model(languages, np.log(smooth / smooth.sum(axis=0)))
    whole = np.bincount(lang, weights=n, minlength=len(languages)) + buckets * smoothing
    cells = counted["bucket"].to_numpy(np.int64) * len(languages) + lang
    order = np.argsort(cells)
    return Model(languages, None, Sparse(cells[order], (np.log(n + smoothing) - np.log(whole[lang]))[order], np.log(smoothing) - np.log(whole), buckets))


def identified(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 3.0, steps: int = 12) -> DataFrame:
    """docs with lang_pred, score, langs and proportions (the selected set, by falling proportion)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def infer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(shared.value.infer(part.tolist(), penalty, steps), columns=["lang_pred", "score", "langs", "proportions"])

    found = docs.withColumn("_found", infer(F.col(text_col)))
    return found.withColumns({k: F.col(f"_found.{k}") for k in kind.names}).drop("_found")
