"""Document vectors: distributed paragraph vectors with negative sampling.

Word matrices (bounded by the vocabulary) are broadcast once an epoch. Documents are dealt to a fixed number of shards by a hash of
their id and pass through a task in the order of that hash; a shard's changes of the matrices are averaged with the other shards' in
whole numbers (2**-40), whose sum doesn't depend on any order. So vectors depend on texts, ids, parameters and seed, not on partitions,
tasks or their order. A document's vector starts at the same point for all documents and is fitted anew in each epoch, so no state of
documents is kept; final vectors, like those of unseen texts, come from the frozen matrices, and equal texts have equal vectors.

Defined results: null and empty texts, and those without a known word, have a vector of zeros; repeated rows have a vector each; words
are what stands between white space. A very long text is worked on in steps of a few words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from ..sources.plugins import parts
from .blocks import summed

_UNIT = float(1 << 40)

#: Words of a text that take a step together; words of a text that are looked up at once; words of texts that take their steps together.
STEP, CHUNK, BLOCK = 32, 2_048, 32_768
#: Parts of [0, 1) by which a draw's word is looked up.
_PARTS = 1 << 16


@dataclass(frozen=True)
class Settings:
    """size: of vectors; window: words to each side (0: the document alone predicts its words); passes: over a text, in training and when frozen."""

    size: int = 100
    window: int = 5
    negatives: int = 5
    rate: float = 0.05
    passes: int = 3
    frozen_passes: int = 20
    seed: int = 42


@dataclass(frozen=True)
class Paragraphs:
    """Trained matrices: a row a word as context (inner) and as target (outer), and what negatives are drawn by."""

    words: tuple[str, ...]
    inner: np.ndarray
    outer: np.ndarray
    drawn: np.ndarray
    settings: Settings

    def start(self) -> np.ndarray:
        return _start(self.settings.seed, self.settings.size)

    def fitted(self, words: np.ndarray, key: int, passes: int, inner: np.ndarray, outer: np.ndarray, learn: bool) -> np.ndarray:
        """The vector of a text, given as places of words. learn: inner and outer (rows side by side in memory) change too. key seeds the negatives."""
        run = self.learned if learn else self.inferred
        return run(words, np.array([len(words)]), np.array([key], np.int64), passes, inner, outer)[0]

    def learned(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray, passes: int, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """A vector a text, text after text: inner and outer change with each step. What doesn't depend on them is made for about CHUNK words at once."""
        s, out, ends = self.settings, np.tile(self.start(), (len(sizes), 1)), np.cumsum(sizes)
        rates = [s.rate * (1 - turn / (passes + 1)) for turn in range(passes)]
        for at, to in parts(sizes, len(sizes), CHUNK):
            begin, rngs = int(ends[at] - sizes[at]), [self._draws(int(k)) for k in keys[at:to]]
            if sizes[at] > CHUNK:  # a text alone
                for rate in rates:
                    for first in range(begin, int(ends[at]), CHUNK):
                        chunk = np.arange(first, min(first + CHUNK, ends[at]))
                        made = self._prepared(words, chunk, begin, int(ends[at]), self._negatives(rngs[0], len(chunk)))
                        out[at] = self._walked(made, 0, len(chunk), out[at], rate, inner, outer)
                continue
            held, chunk = sizes[at:to], np.arange(begin, ends[to - 1])
            draws = [[rng.random((n, s.negatives)) for _ in rates] for rng, n in zip(rngs, held.tolist(), strict=True)]
            begins, stops = (np.repeat(x, held)[:, None] for x in (ends[at:to] - held, ends[at:to]))
            turns = [self._prepared(words, chunk, begins, stops, self._words_at(np.concatenate([d[turn] for d in draws]))) for turn in range(passes)]
            for i, n in enumerate(held.tolist(), at):
                for made, rate in zip(turns, rates, strict=True):
                    out[i] = self._walked(made, int(ends[i]) - n - begin, n, out[i], rate, inner, outer)
        return out

    def _prepared(self, words: np.ndarray, chunk: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int, drawn: np.ndarray) -> tuple:
        """Of the words at places of texts that lie from begin to end: targets, what they say, words around them, where there is one, their count with the document, up to where how
        many words lack one, and places of the targets' and the context's numbers in flat matrices."""
        s = self.settings
        (context, there), across = self._around(words, chunk, begin, end), np.arange(s.size)
        targets = np.c_[words[chunk], drawn]
        lacking = np.r_[0, np.cumsum(there.sum(axis=1) < there.shape[1])].tolist()
        at_outer, at_inner = ((x[..., None] * s.size + across).reshape(len(x), x.shape[1] * s.size) for x in (targets, context))
        return targets, _said(words[chunk], drawn), context, there, 1.0 + there.sum(axis=1, keepdims=True), lacking, at_outer, at_inner

    def _walked(self, made: tuple, begin: int, n: int, vector: np.ndarray, rate: float, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """The vector after the steps of n prepared words from begin on."""
        targets, said, context, there, count, lacking, at_outer, at_inner = made
        flat_inner, flat_outer, around, size = inner.reshape(-1), outer.reshape(-1), context.shape[1], self.settings.size
        for at in range(begin, begin + n, STEP):
            to = min(at + STEP, begin + n)
            own = slice(at, to)
            rows = outer.take(targets[own], axis=0)
            hidden = (vector + np.einsum("wcs,wc->ws", inner.take(context[own], axis=0), there[own])) / count[own] if around else np.broadcast_to(vector, (to - at, size))
            gap = _gap(rows, hidden, said[own]) * rate
            back = np.einsum("wk,wks->ws", gap, rows)
            np.add.at(flat_outer, at_outer[own].reshape(-1), (gap[..., None] * hidden[:, None, :]).reshape(-1))
            if around:
                given = np.repeat(back, around, axis=0) if lacking[to] == lacking[at] else there[own][..., None] * back[:, None, :]  # what isn't there adds 0
                np.add.at(flat_inner, at_inner[own].reshape(-1), given.reshape(-1))
            vector = vector + back.sum(axis=0)
        return vector

    def _draws(self, key: int) -> np.random.Generator:
        return np.random.default_rng([self.settings.seed, key & 0xFFFFFFFF, (key >> 32) & 0xFFFFFFFF])

    def _negatives(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return self._words_at(rng.random((n, self.settings.negatives)))

    @cached_property
    def _guide(self) -> tuple[np.ndarray, np.ndarray]:
        """The word of each part of [0, 1), and whether the whole part is that word's."""
        ends = np.searchsorted(self.drawn, np.arange(_PARTS + 1) / _PARTS, side="right")
        return ends[:-1], ends[:-1] == ends[1:]

    def _words_at(self, draws: np.ndarray) -> np.ndarray:
        """``np.searchsorted(self.drawn, draws, side="right")``; only draws in parts of several words are searched for."""
        words, whole = self._guide
        part = (draws * _PARTS).astype(np.int64)
        out = words[part]
        rest = np.nonzero(~whole[part])
        out[rest] = np.searchsorted(self.drawn, draws[rest], side="right")
        return out

    def _around(self, words: np.ndarray, at: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Words around places of a text that lies from begin to end, and 1 where there is one."""
        w = self.settings.window
        around = at[:, None] + np.r_[-w:0, 1 : w + 1]
        there = (around >= begin) & (around < end)
        return words.take(around, mode="clip"), there.astype(float)

    def inferred(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray, passes: int, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """A vector a text by frozen matrices. words: places of all texts' words, text after text; texts without one have zeros. Texts of like lengths take
        their steps together, as many as hold about BLOCK words; a text's vector doesn't depend on those beside it."""
        out, ends = np.zeros((len(sizes), self.settings.size)), np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        at = 0
        while at < len(order):
            to = at + max(1, BLOCK // int(sizes[order[at]]))
            block = order[at:to]
            out[block] = self._together(words, ends[block] - sizes[block], ends[block], keys[block], passes, inner, outer)
            at = to
        return out

    def _together(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray, passes: int, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Vectors of texts whose lengths fall."""
        s, sizes = self.settings, ends - begins
        vectors, rngs, made = np.tile(self.start(), (len(sizes), 1)), [self._draws(int(k)) for k in keys], None
        for turn in range(passes):
            rate = s.rate * (1 - turn / (passes + 1))
            for first in range(0, int(sizes[0]), CHUNK):
                if made is None or sizes[0] > CHUNK:  # what is around the words is the same in each turn
                    made = self._steps(words, begins, ends, first, inner)
                chunk, held, steps = made
                drawn = self._words_at(np.concatenate([rng.random((n, s.negatives)) for rng, n in zip(rngs, held.tolist(), strict=False)]))
                targets, said = np.c_[chunk, drawn], _said(chunk, drawn)
                for live, here, inside, near, count in steps:
                    rows = outer.take(targets.take(here, axis=0), axis=0)
                    hidden = ((vectors[:live, None] + near) / count).reshape(-1, s.size)
                    gap = _gap(rows, hidden, said.take(here, axis=0) * inside)
                    vectors[:live] += (np.einsum("wk,wks->ws", gap, rows) * rate).reshape(live, STEP, s.size).sum(axis=1)
        return vectors

    def _steps(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: int, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """The texts' words from ``first`` on, CHUNK of each at most; how many each text that is left has; and of each step: how many texts take it, the places of their words,
        1 where there is a word, the sum of the words around it and their count with the document."""
        s, sizes = self.settings, ends - begins
        held = np.minimum(sizes[: np.count_nonzero(sizes > first)] - first, CHUNK)
        starts = np.cumsum(held) - held
        own = np.arange(held.sum()) + np.repeat(begins[: len(held)] + first - starts, held)
        count, near, steps = np.ones((len(own), 1)), np.zeros((len(own), s.size)), []
        if s.window:
            context, there = self._around(words, own, np.repeat(begins[: len(held)], held)[:, None], np.repeat(ends[: len(held)], held)[:, None])
            count += there.sum(axis=1, keepdims=True)
            for c in range(context.shape[1]):
                near += inner.take(context[:, c], axis=0) * there[:, c, None]
        for at in range(0, int(held[0]), STEP):
            live = np.count_nonzero(held > at)
            place = at + np.arange(STEP)
            inside = place < held[:live, None]
            here = np.where(inside, starts[:live, None] + place, 0)
            steps.append((live, here.reshape(-1), inside.reshape(-1, 1).astype(float), near[here], count[here]))
        return words[own], held, steps

    def vectors(self, docs: DataFrame, text_col: str = "text", out: str = "vector") -> DataFrame:
        """docs with their vectors."""
        shared = docs.sparkSession.sparkContext.broadcast((self.words, self.inner, self.outer, self.drawn, self.settings))

        @F.arrow_udf("array<double>")
        def infer(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = Paragraphs(*shared.value)
            settings = model.settings
            for texts, keys in batches:
                found = np.zeros((len(texts), settings.size))
                for at, to in _portions(texts):
                    places, sizes = numbered(tokens(texts.slice(at, to - at)), model.words)
                    found[at:to] = model.inferred(places, sizes, keys.slice(at, to - at).to_numpy(), settings.frozen_passes, model.inner, model.outer)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * settings.size, pa.int32()), pa.array(found.ravel()))

        text = F.coalesce(F.col(text_col), F.lit(""))
        return docs.withColumn(out, infer(text, F.xxhash64(text)))


@lru_cache(8)
def _start(seed: int, size: int) -> np.ndarray:
    found = (np.random.default_rng(seed).random(size) - 0.5) / size
    found.flags.writeable = False
    return found


def _own(matrix: np.ndarray) -> np.ndarray:
    """A copy to add to. It has numpy's own double type, not one that came with a broadcast: ``np.add.at`` is many times slower on such ones."""
    out = np.empty(matrix.shape)
    out[:] = matrix
    return out


def _said(words: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """1 for each word and its negatives, 0 for a negative that is the word itself, which says nothing."""
    return np.c_[np.ones(len(words)), drawn != words[:, None]]


def _gap(rows: np.ndarray, hidden: np.ndarray, said: np.ndarray) -> np.ndarray:
    """What is wanted less what comes out, of each word and its negatives."""
    out = np.einsum("wks,ws->wk", rows, hidden)
    gap = -1 / (1 + np.exp(-np.minimum(np.maximum(out, -30), 30)))
    gap[:, 0] += 1
    return gap * said


def numbered(tokens: pa.ListArray, words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the known words of all texts, text after text, and how many each text has."""
    flat, sizes = tokens.flatten(), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = pc.index_in(flat, value_set=pa.array(words, flat.type))
    text = np.repeat(np.arange(len(sizes)), sizes)[found.is_valid().to_numpy(zero_copy_only=False)]
    return found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(text, minlength=len(sizes))


def tokens(texts: pa.Array) -> pa.ListArray:
    """What stands between ASCII white space, with empty words at the ends of some texts; null texts have none."""
    return pc.ascii_split_whitespace(texts.fill_null(""))


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1 << 14, 1 << 23)


def trained(docs: DataFrame, id_col: str, text_col: str = "text", settings: Settings = Settings(), min_count: int = 2, epochs: int = 10, shards: int = 8, max_words: int = 20_000) -> Paragraphs:
    """Matrices of words with at least min_count places, the max_words commonest at most (a bound of the driver's and each task's memory)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _portions(batch.column(0)):
                found = tokens(batch.column(0).slice(at, to - at)).flatten().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["w", "n"])

    counts = docs.select(text.alias("text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) & (F.col("w") != ""))
    kept = counts.orderBy(F.desc("n"), "w").limit(max_words).collect()  # max_words rows
    words = tuple(r.w for r in kept)
    weight = np.array([r.n for r in kept], dtype=float) ** 0.75
    drawn = np.cumsum(weight / weight.sum())[:-1] if len(kept) else np.zeros(0)
    s, v = settings, len(words)
    rng = np.random.default_rng(s.seed + 1)
    inner = (rng.random((v, s.size)) - 0.5) / s.size
    outer = (rng.random((v, s.size)) - 0.5) / np.sqrt(s.size)  # not zeros: all documents start at one point, so words must not
    model = Paragraphs(words, inner, outer, drawn, s)
    if not v:
        return model
    known = docs.sparkSession.sparkContext.broadcast(words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _portions(batch.column("text")):
                part = batch.slice(at, to - at)
                places, sizes = numbered(tokens(part.column("text")), known.value)
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("h"), part.column("key"), found], names=["shard", "h", "key", "words"])

    cut = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text).alias("key"), text.alias("text"))
    dealt = cut.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "key", "text")
    rows = stored(dealt.mapInArrow(number, "shard int, h long, key long, words array<int>").filter(F.size("words") > 0), "numbered_words")
    ordered = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "key")
    for epoch in range(epochs):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[np.ndarray]:
            base, shard, inner, outer = shared.value, None, None, None

            def changes() -> np.ndarray:
                moved = np.c_[inner - base.inner, outer - base.outer]
                return np.c_[np.rint(moved * _UNIT).astype(np.int64), moved.any(axis=1)]

            for batch in batches:
                flat, sizes = batch.column("words").flatten().to_numpy().astype(np.int64), batch.column("words").value_lengths().to_numpy().astype(np.int64)
                keys, shard_of, ends = batch.column("key").to_numpy(), batch.column("shard").to_numpy(), np.r_[0, np.cumsum(sizes)]
                cuts = np.flatnonzero(np.diff(shard_of)) + 1
                for at, to in itertools.pairwise([0, *cuts.tolist(), len(sizes)]):
                    here = int(shard_of[at])
                    if here != shard:
                        if shard is not None:
                            yield changes()
                        shard, inner, outer = here, _own(base.inner), _own(base.outer)
                    base.learned(flat[ends[at] : ends[to]], sizes[at:to], keys[at:to] + epoch, base.settings.passes, inner, outer)
            if shard is not None:
                yield changes()

        total = summed(ordered, learn, (v, 2 * s.size + 1), "int64")
        shared.unpersist()
        mean = total[:, :-1] / _UNIT / np.maximum(total[:, -1:], 1)  # over the shards that a word's row changed in
        model = Paragraphs(words, model.inner + mean[:, : s.size], model.outer + mean[:, s.size :], drawn, s)
    return model
