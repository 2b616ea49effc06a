"""The default tagger: a hidden Markov model that Spark counts and Viterbi reads in Arrow batches. Any plug-in of the same kind takes its place."""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import checkpoint_dir
from ..sources.plugins import ROOM, Plugin, parts

SENTENCES = "array<array<struct<word:string,tag:string>>>"
_OUT, _NEVER = "O", -1e9
_MARK, _LETTER, _SPACE, _JOINER = range(4)
_ENDS = np.isin(np.arange(128), [ord(c) for c in ".!?"])
#: Scores of places that a block keeps, those of a step, and words whose rows a process keeps.
_KEPT, _STEP, _KNOWN = 1 << 19, 1 << 15, 1 << 18


@dataclass(frozen=True)
class Seed:
    """A pattern whose matches bear a tag: distant labels to fit a tagger with."""

    tag: str
    pattern: str


@lru_cache(1)
def _kinds() -> np.ndarray:
    """A byte a code point: a letter, digit or underscore as ``\\w`` has it, white space, a joiner of words, or a mark."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    found = np.full(len(every), _MARK, np.uint8)
    for kind, pattern in ((_LETTER, r"\w+"), (_SPACE, r"\s+"), (_JOINER, r"[-'’.,]")):
        for m in re.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


@dataclass(frozen=True)
class Words:
    """The words and marks of several texts, joined by line feeds: where each starts and ends there, its text, whether it begins a sentence; and where each text begins."""

    joined: str
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    bases: np.ndarray

    def strings(self) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def arrow(self) -> pa.Array:
        """The same strings, without a Python object each."""
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        edges = np.zeros(len(codes) + 1, np.int8)
        edges[self.starts] += 1
        edges[self.ends] -= 1
        held = codes[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
        width = np.r_[0, np.cumsum(1 + (held >= 0x80) + (held >= 0x800) + (held >= 0x10000))]
        places = width[np.r_[0, np.cumsum(self.ends - self.starts)]].astype(np.int32)
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(places), pa.py_buffer(held.tobytes().decode("utf-32-le").encode()))


def words_of(texts: Sequence[str | None]) -> Words:
    """Words are ``\\w+(?:[-'’.,]\\w+)*``, any other character but white space is a mark. A sentence ends at ``.``, ``!``, ``?`` or a line feed."""
    texts = ["" if t is None else t for t in texts]
    joined = "\n".join(texts)
    bases = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Words(joined, none, none, none, np.zeros(0, bool), bases)
    kind = _kinds()[codes]
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = letter = kind == _LETTER
    inside[2:-2] |= (kind[1:-1] == _JOINER) & letter[:-2] & letter[2:]  # between two letters
    within = inside[1:-1]
    mark = ~within & (kind != _SPACE)
    starts, last = np.flatnonzero(within & ~inside[:-2] | mark), np.flatnonzero(within & ~inside[2:] | mark)
    begins = np.ones(len(starts), bool)
    lines = np.cumsum(codes == 10, dtype=np.int32)[starts]
    begins[1:] = (lines[1:] != lines[:-1]) | _ENDS[np.minimum(codes[starts[:-1]], 127)]
    return Words(joined, starts, last + 1, np.searchsorted(bases, starts, "right") - 1, begins, bases)


def sentences(text: str | None) -> Iterator[list[tuple[str, int, int]]]:
    """(word, start, end) of each word and mark, a sentence ending at ``.``, ``!``, ``?`` or a line feed."""
    found = words_of([text])
    rows = list(zip(found.strings(), found.starts.tolist(), found.ends.tolist(), strict=True))
    for at, to in itertools.pairwise([*np.flatnonzero(found.begins).tolist(), len(rows)]):
        yield rows[at:to]


def shapes(word: str) -> tuple[str, str]:
    """What stands for a word that the model doesn't hold: its kind with its last two letters, else its kind alone."""
    kind = "number" if word[0].isdigit() else "mark" if not word[0].isalnum() else "capitals" if len(word) > 1 and word.isupper() else "capital" if word[0].isupper() else "word"
    return f"\t{kind} {word[-2:].lower()}", f"\t{kind}"


@dataclass(frozen=True)
class _Labels:
    """Names of tags, and how the words of texts get theirs: from the first seed that matches there."""

    names: list[str]
    compiled: list[tuple[int, int, re.Pattern]]

    @classmethod
    def of(cls, seeds: Sequence[Seed], spans: bool, default: str) -> _Labels:
        pairs = [(f"B-{s.tag}", f"I-{s.tag}") if spans else (s.tag, s.tag) for s in seeds]
        names = list(dict.fromkeys([default, *itertools.chain.from_iterable(pairs)]))
        return cls(names, [(names.index(a), names.index(b), re.compile(s.pattern)) for (a, b), s in zip(pairs, seeds, strict=True)])

    def places(self, texts: Sequence[str | None], words: Words) -> list[int]:
        """Each word's tag, by its place among the names."""
        tags = [0] * len(words.starts)
        for begin, inside, pattern in self.compiled:
            matches = [[(base + m.start(), base + m.end()) for m in pattern.finditer(t or "")] for t, base in zip(texts, words.bases.tolist(), strict=True)]
            spots = np.array(list(itertools.chain.from_iterable(matches)), np.int64).reshape(-1, 2)
            for first, last in zip(np.searchsorted(words.ends, spots[:, 0], "right").tolist(), np.searchsorted(words.starts, spots[:, 1], "left").tolist(), strict=True):
                if first < last and not any(tags[first:last]):
                    tags[first:last] = [begin, *[inside] * (last - first - 1)]
        return tags


def labelled(text: Column, seeds: Sequence[Seed], spans: bool = True, default: str = _OUT) -> Column:
    """Sentences of words with tags. A word that overlaps a match bears the tag of the first seed that matches there, as ``B-`` at the match's
    first word and ``I-`` behind it where spans are tagged; else the default. Null and empty texts have no sentences."""
    labels = _Labels.of(seeds, spans, default)

    def of(texts: list[str | None]) -> pa.Array:
        words = words_of(texts)
        tags = labels.places(texts, words)
        rows = pa.StructArray.from_arrays([pa.array(words.strings(), pa.string()), pa.array(labels.names, pa.string()).take(pa.array(tags, pa.int32()))], names=["word", "tag"])
        ends = np.searchsorted(words.text[words.begins], np.arange(len(texts)), "right")
        found = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(words.begins), len(tags)], pa.int32()), rows)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), found)

    @F.arrow_udf(SENTENCES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at, to in _portions(texts):
                yield of(texts.slice(at, to - at).to_pylist())

    return run(text)


def _portions(texts: pa.Array, most: int = 1_000, room: int = ROOM) -> Iterator[tuple[int, int]]:
    return parts(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), most, room)


@dataclass(frozen=True)
class Tagger:
    """Logarithms: of the first tag, of the next tag for a tag, of a word or shape (by row) for a tag. The last row is that of anything else."""

    tags: tuple[str, ...]
    first: np.ndarray
    following: np.ndarray
    rows: dict[str, int]
    emitted: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def _rows(self, words: list[str]) -> np.ndarray:
        """A word's row, or that of its first known shape; looked up once a word and process, as long as there are few."""
        if len(self.known) > _KNOWN:
            self.known.clear()
        for word in {*words}.difference(self.known):
            self.known[word] = next((self.rows[k] for k in (word.lower(), *shapes(word)) if k in self.rows), len(self.emitted) - 1)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def best(self, sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The likeliest tags of each sequence of rows; ties go to the earlier tag. A sequence's result doesn't depend on the others."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        path = self._paths(np.concatenate([np.zeros(0, np.int64), *sequences]), sizes)
        return np.split(path, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def _paths(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same of sequences that follow each other in ``rows``. Those of like lengths go through the recursion together, the longest first, in
        blocks that keep about 2^19 scores, or alone."""
        path, begins = np.empty(len(rows), np.int64), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        at, width = 0, max(64, _STEP // len(self.tags) ** 2)
        while at < len(order):
            block = order[at : at + max(1, min(width, _KEPT // (len(self.tags) * int(sizes[order[at]]))))]
            self._block(rows, begins[block], sizes[block], path)
            at += len(block)
        return path

    def _block(self, rows: np.ndarray, begins: np.ndarray, sizes: np.ndarray, path: np.ndarray) -> None:
        """Tags of sequences by falling length into ``path``. The way back finds each tag's predecessor from the kept scores."""
        onwards = self.following.T[:, :, None].copy()  # to a tag, from a tag
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # sequences that reach a place
        score = np.ascontiguousarray((self.first + self.emitted[rows[begins]]).T)
        kept = [score]
        for t in range(1, sizes[0]):
            n = active[t]
            score = (score[:, :n] + onwards).max(axis=1) + self.emitted[rows[begins[:n] + t]].T
            kept.append(score)
        tag = np.zeros(len(sizes), np.int64)
        for t in range(sizes[0] - 1, -1, -1):
            n, goes_on, score = active[t], active[t + 1] if t + 1 < sizes[0] else 0, kept.pop()
            tag[goes_on:n] = score[:, goes_on:].argmax(axis=0)
            tag[:goes_on] = (score[:, :goes_on] + self.following[:, tag[:goes_on]]).argmax(axis=0)
            path[begins[:n] + t] = tag[:n]

    def _tagged(self, texts: Sequence[str | None]) -> tuple[Words, list[str], np.ndarray]:
        """The texts' words, as strings too, and each one's tag by number."""
        words = words_of(texts)
        strings, begins = words.strings(), np.flatnonzero(words.begins)
        return words, strings, self._paths(self._rows(strings), np.diff(np.r_[begins, len(strings)]))

    def tagged(self, texts: Sequence[str | None]) -> list[list[tuple[str, int, int, str, int]]]:
        """(word, start, end, tag, sentence) of each word of each text."""
        words, strings, path = self._tagged(texts)
        number, base, ends = np.cumsum(words.begins), words.bases[words.text], np.searchsorted(words.text, np.arange(len(texts)), "right").tolist()
        number -= number[np.searchsorted(words.text, words.text, "left")]
        rows = list(zip(strings, (words.starts - base).tolist(), (words.ends - base).tolist(), [self.tags[k] for k in path.tolist()], number.tolist(), strict=True))
        return [rows[at:to] for at, to in itertools.pairwise([0, *ends])]

    def entities(self, texts: Sequence[str | None]) -> list[list[dict]]:
        """Spans of words tagged ``B-`` and ``I-``, as label, start, end and text, offsets in code points."""
        words, _, path = self._tagged(texts)
        out: list[list[dict]] = [[] for _ in texts]
        places = np.flatnonzero(np.array([t[:2] in ("B-", "I-") for t in self.tags])[path])
        for i, base, start, end, k in zip(*(x.tolist() for x in (words.text[places], words.bases[words.text[places]], words.starts[places], words.ends[places], path[places])), strict=True):
            if self.tags[k].startswith("B-"):
                out[i].append({"label": self.tags[k][2:], "start": start - base, "end": end - base})
            else:
                out[i][-1]["end"] = end - base
        return [[f | {"text": text[f["start"] : f["end"]]} for f in found] for text, found in zip(texts, out, strict=True)]

    def tokens(self, texts: Sequence[str | None]) -> list[list[dict]]:
        """Words with their tags, for taggers of parts of speech."""
        return [[{"word": w[0], "tag": w[3]} for w in words] for words in self.tagged(texts)]

    def plugin(self, kind: str = "entities", batch: int = 1_000) -> Plugin:
        return Plugin(kind, {"entities": self.entities, "tokens": self.tokens}[kind], batch)


def fitted(tagged: DataFrame, sentence_col: str, max_words: int = 50_000, least: int = 2, smoothing: float = 0.1) -> Tagger:
    """A tagger counted from sentences (arrays of word and tag; null ones and empty ones count for nothing).

    One aggregation over words with their tags and the tags before them. The model holds the ``max_words`` most frequent lower-case words that stand
    ``least`` times or more (ties by the word), so it is bounded by that parameter and the number of tags, of which there may be 255. Other
    words go by the distinct words of their shape. ``I-x`` follows only ``B-x`` and ``I-x``. No sentence at all: every word is ``O``."""
    s = F.col(sentence_col)
    pairs = F.transform(s, lambda w, i: F.struct(F.when(i > 0, F.get(s, i - 1)["tag"]).alias("before"), w.word.alias("word"), w.tag.alias("tag")))
    return _counted(tagged.select(F.explode(pairs).alias("p")).select("p.*", F.lit(1).cast("long").alias("n")), max_words, least, smoothing)


def fitted_by_seeds(docs: DataFrame, text_col: str, seeds: Sequence[Seed], spans: bool = True, default: str = _OUT, max_words: int = 50_000, least: int = 2, smoothing: float = 0.1) -> Tagger:
    """``fitted`` on the sentences that ``labelled`` makes of all texts. They aren't made: a task counts the words, tags and tags before of many texts in Arrow,
    and only these counts leave it."""
    labels = _Labels.of(seeds, spans, default)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, names = len(labels.names), pa.array(labels.names, pa.string())
        for batch in batches:
            for at, to in _portions(batch.column(0), 1 << 14, 2 * ROOM):
                texts = batch.column(0).slice(at, to - at).to_pylist()
                words = words_of(texts)
                if not len(words.starts):
                    continue
                held, tags = words.arrow().dictionary_encode(), np.array(labels.places(texts, words), np.int64)
                before = np.where(words.begins, k, np.roll(tags, 1))
                cells, n = np.unique((held.indices.to_numpy().astype(np.int64) * k + tags) * (k + 1) + before, return_counts=True)
                before, tags, word = cells % (k + 1), cells // (k + 1) % k, cells // ((k + 1) * k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(before, mask=before == k)), held.dictionary.take(pa.array(word)), names.take(pa.array(tags)), pa.array(n, pa.int64())], names=["before", "word", "tag", "n"])

    return _counted(docs.select(text_col).mapInArrow(count, "before string, word string, tag string, n long"), max_words, least, smoothing)


def _counted(found: DataFrame, max_words: int, least: int, smoothing: float) -> Tagger:
    """A tagger from counts (n) of words with their tags and the tags before them; equal ones may stand in several rows."""
    checkpoint_dir(found.sparkSession)
    cells = found.groupBy("before", "word", "tag").agg(F.sum("n").alias("n")).checkpoint()  # the texts are read once
    counts = cells.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    steps = cells.groupBy("before", "tag").agg(F.sum("n").alias("n")).collect()

    @F.pandas_udf("array<string>")
    def shapes_of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: list(shapes(w)))

    known = counts.groupBy(F.lower("word").alias("key")).agg(F.sum("n").alias("total")).filter(F.col("total") >= least).orderBy(F.desc("total"), "key").limit(max_words)
    of_words = counts.withColumn("key", F.lower("word")).join(known.select("key"), "key").groupBy("key", "tag").agg(F.sum("n").alias("n"))
    of_shapes = counts.select(F.explode(shapes_of("word")).alias("key"), "tag").groupBy("key", "tag").agg(F.count("*").alias("n"))
    emissions = [(r.key, r.tag, r.n) for r in of_words.union(of_shapes.filter(F.col("n") >= least)).collect()]
    tags = tuple(sorted({r.tag for r in steps})) or (_OUT,)
    if len(tags) > 255:
        raise ValueError(f"{len(tags)} tags: at most 255 fit one byte")
    place = {t: i for i, t in enumerate(tags)}
    first, following = np.full(len(tags), smoothing), np.full((len(tags), len(tags)), smoothing)
    for r in steps:
        if r.before is None:
            first[place[r.tag]] += r.n
        else:
            following[place[r.before], place[r.tag]] += r.n
    rows = {k: i for i, k in enumerate(sorted({c[0] for c in emissions}))}
    emitted = np.full((len(rows) + 1, len(tags)), smoothing)
    words, kinds = np.zeros(len(tags)), np.zeros(len(tags))
    for key, tag, n in emissions:
        emitted[rows[key], place[tag]] += n
        if not key.startswith("\t"):
            words[place[tag]] += n
        elif " " not in key:
            kinds[place[tag]] += n
    is_shape = np.array([k.startswith("\t") for k in rows] + [True])
    total = np.where(is_shape[:, None], kinds, words) + smoothing * (len(rows) + 1)
    inside = np.array([t.startswith("I-") for t in tags])
    allowed = np.array([[not t.startswith("I-") or b[:2] in ("B-", "I-") and b[2:] == t[2:] for t in tags] for b in tags])
    return Tagger(tags, np.where(inside, _NEVER, np.log(first / first.sum())), np.where(allowed, np.log(following / following.sum(axis=1, keepdims=True)), _NEVER), rows, np.log(emitted / total))
