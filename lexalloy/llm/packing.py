"""Packing of whole documents into token windows (operator 1): lexical retrieval packing.

Steps, each over all rows:

1. ``tokenised``: every text becomes token ids (one scan; stored, because later steps read it). Each task also counts, for
   every word, the documents that hold it. A word is a run of ids up to one that ends a word.
2. ``frequent_words``: exact document frequencies (a Spark aggregation by word hash). Only words that are in a share of the
   documents are brought to the driver and broadcast: as all frequencies add up to the number of (document, word) pairs,
   at most ``most_frequent`` words can have ``pairs / most_frequent`` or more, whatever the size of the corpus.
3. ``keyed``: a document's full windows stand for themselves; what is left (under one window) is a *unit*. Its key is the
   first of its ``sketch`` words (those with the least hashes, so that documents pick the same ones) that isn't frequent:
   documents that share rare words get the same key with the probability that their rare words coincide.
4. ``packed``: units are dealt by range of (key, row); the row breaks every tie, so that no group of copies makes a large
   partition. Each partition is worked off in shards of at most ``shard_units`` units: a shard is a BM25 inverted index
   over its units, with the exact corpus frequencies of frequent words, and its own counts for rarer ones. The longest
   unused unit is the seed; all its words that another unit holds, and that no more than half of the shard does, retrieve
   the unused neighbours by BM25, which fill the window greedily, best first; the last one is cut, and its rest stays in
   the index. What a shard can't fill goes on to the next shard of the partition.
5. What partitions can't fill (less than a window each) is packed again, 64 partitions in one, until one partition is left.
   Only its last sequence is cut into powers of two, so at most log2(window) sequences of the whole corpus are short.

Memory: texts reach a task in Arrow batches of ``batch_rows`` rows and are encoded in slices of ``_SLICE_BYTES``; a single
text is held whole. Fixed shares of a worker: the memo, one shard, the frequent words.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each; an empty table
gives an empty table; a text of many windows is cut at window ends; columns of ``docs`` other than id and text are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, dropped, stored

#: A text with a character that Arrow and the tokenizer may treat differently, or with a special string, is encoded whole.
_NOT_PLAIN = "[^\\x00-\\x{24f}\\x{400}-\\x{45f}\\x{2010}-\\x{2027}\\x{20ac}]|[\\x0b\\x1c-\\x1f\\x85\\x{130}]|<\\|"
#: Fixed: what the tokenizer cuts off as a piece of its own within a run of other characters.
_CUTS = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\xa0\pL\pN]+)"
_MEMO_MAX, _PIECE_MAX, _SLICE_BYTES = 400_000, 100, 4_000_000
_HASH_BITS = 44
_HASH_MASK = np.uint64((1 << _HASH_BITS) - 1)
_COUNTS_A_ROW = 65_536

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class PieceIds:
    """Ids of texts by their pieces, whose ids are remembered. The tokenizer lower-cases a text, drops white space and
    cuts it into pieces, which it encodes each for itself; so a text's ids are those of its pieces, one after the other.
    Arrow does it in steps, each for distinct values of a slice of texts only: texts into runs without white space, runs
    into pieces, pieces into remembered ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.of_pieces):
            t.no_truncation()
            t.no_padding()
        # pieces are lower-cased and cut already, and hold no character that the normalizer changes otherwise (_NOT_PLAIN)
        self.of_pieces.normalizer = None
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u2"), np.zeros(0, np.int64)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (unsigned 16-bit), one text after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(plain, texts, "")))
        runs = pc.dictionary_encode(lists.values)
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(runs.dictionary, pattern=_CUTS, replacement=r" \1 "))
        pieces = pc.dictionary_encode(cut.values)
        of_runs, run_sizes = _joined(*self._ids_of(pieces.dictionary), pieces.indices.to_numpy(), cut.offsets.to_numpy())
        ids, lengths = _joined(of_runs, run_sizes, runs.indices.to_numpy(), lists.offsets.to_numpy())
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(other):
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in other.tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u2")
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids, lengths

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def _ids_of(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one piece after the other, and how many each has."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        fresh, fresh_sizes = self._encoded(new.to_pylist())
        flat, sizes = np.concatenate((self.flat, fresh)), np.concatenate((self.sizes, fresh_sizes))
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        found = _joined(flat, sizes, place, np.arange(len(place) + 1))
        # a full memo is left for the pieces of this slice, which hold the frequent ones; long pieces aren't remembered
        if len(sizes) > _MEMO_MAX:
            self.known, self.flat, self.sizes = pieces, *found
        else:
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, new]), flat, sizes
        stay = (pc.binary_length(self.known).to_numpy() <= _PIECE_MAX) & (np.arange(len(self.known)) < _MEMO_MAX)
        if not stay.all():
            kept = np.flatnonzero(stay)
            self.flat, self.sizes = _joined(self.flat, self.sizes, kept, np.arange(len(kept) + 1))
            self.known = self.known.filter(pa.array(stay))
        return found

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encoded in one go, and cut behind each id that ends a word. (The empty string has no ids.)"""
        filled = np.array([p != "" for p in pieces], dtype=bool)
        sizes = np.zeros(len(pieces), np.int64)
        if not filled.any():
            return np.zeros(0, "<u2"), sizes
        ids = np.array(self.of_pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u2")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == filled.sum():
            sizes[filled] = np.diff(cuts, prepend=0)
            return ids, sizes
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for e in each for i in e], dtype="<u2"), np.array([len(e) for e in each], dtype=np.int64)


def _joined(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the values with these codes, one after the other, and how many fall to each list of codes within bounds.
    Value i has sizes[i] ids; flat holds those of all values in order."""
    begin, many = np.cumsum(sizes) - sizes, sizes[codes]
    upto = np.concatenate(([0], np.cumsum(many)))
    return flat[np.arange(upto[-1]) + np.repeat(begin[codes] - upto[:-1], many)], np.diff(upto[bounds])


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceIds:
    return PieceIds(path)


@lru_cache(maxsize=2)
def word_ends(path: str, end_id: int) -> np.ndarray:
    """For each id: whether it ends a word."""
    ends = _pieces(path).ends.copy()
    ends[end_id] = True
    return ends


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most about most_bytes (a single text may have more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes + 64) // most_bytes
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)] if len(batch) else [0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)


def word_hashes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash (of _HASH_BITS bits) of each word in ids and the words' first positions. ends: for each id, whether it ends a word."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = ends[ids]
    stop[-1] = True
    first = np.concatenate(([0], np.flatnonzero(stop)[:-1] + 1))
    place = np.arange(len(ids), dtype=np.uint64) - np.repeat(first, np.diff(np.concatenate((first, [len(ids)])))).astype(np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * place * np.uint64(0xBF58476D1CE4E5B9))
    total = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), first)
    return (total * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - _HASH_BITS), first


def _terms(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending by document and word hash: the place of the document, the hash, and how often it occurs there. ids: those
    of the documents, without end ids, one after the other."""
    hashes, first = word_hashes(ids, ends)
    doc = np.searchsorted(np.cumsum(lengths), first, side="right").astype(np.uint64)
    both = np.sort((doc << np.uint64(_HASH_BITS)) | hashes)
    new = np.flatnonzero(np.concatenate((np.ones(min(len(both), 1), bool), both[1:] != both[:-1])))
    return (both[new] >> np.uint64(_HASH_BITS)).astype(np.int64), (both[new] & _HASH_MASK).astype(np.int64), np.diff(np.concatenate((new, [len(both)])))


def tokenised(docs: DataFrame, path: str, end_id: int, sketch: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For vocabularies under 65,536 ids: row (unique), doc_id, ids (unsigned 16-bit, with the end id), n (their number),
    words (their number), sketch (the least hashes of the text's words). Each task adds rows without ids, whose word and df
    say in how many of its documents each word is."""
    names = ["row", "doc_id", "ids", "n", "words", "sketch", "word", "df"]
    longs = pa.list_(pa.int64())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ends, counted, held = _pieces(path), word_ends(path, end_id), [], 0
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                ids, lengths = pieces.encode_many(part.column("text"))
                doc, word, times = _terms(ids, lengths, ends)
                bounds = np.searchsorted(doc, np.arange(len(part) + 1))
                of_word, df = np.unique(word, return_counts=True)
                counted.append((of_word, df))
                held += len(of_word)
                if held > 4_000_000:  # bounds the memory of one task's counts
                    counted, held = [_summed(counted)], 0
                kept = np.minimum(np.diff(bounds), sketch)
                at = np.arange(kept.sum()) + np.repeat(bounds[:-1] - np.cumsum(kept) + kept, kept)
                upto = np.cumsum(lengths)
                whole = np.insert(ids, upto, end_id).astype("<u2")  # an end id behind each text
                offsets = pa.py_buffer(np.concatenate(([0], 2 * (upto + np.arange(1, len(part) + 1)))).astype(np.int64))
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, offsets, pa.py_buffer(whole)]).cast(pa.binary())
                sketches = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), pa.array(word[at], pa.int64()))
                number = np.bincount(doc, weights=times, minlength=len(part)).astype(np.int64)
                empty = pa.nulls(len(part), longs)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), binary, pa.array(lengths + 1, pa.int64()), pa.array(number), sketches, empty, empty], names)
        of_word, df = _summed(counted)
        for a in range(0, len(of_word), _COUNTS_A_ROW):
            values = [[-1], [None], [None], [0], [0], [None], [of_word[a : a + _COUNTS_A_ROW]], [df[a : a + _COUNTS_A_ROW]]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "row long, doc_id long, ids binary, n long, words long, sketch array<long>, word array<long>, df array<long>")


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not counted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, place = np.unique(np.concatenate([w for w, _ in counted]), return_inverse=True)
    return word, np.bincount(place, weights=np.concatenate([n for _, n in counted]), minlength=len(word)).astype(np.int64)


def frequent_words(tokens: DataFrame, most_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and exact document frequencies of the words with at least 1 / most_frequent of all (document, word)
    pairs, and at least 3 documents: at most ``most_frequent`` of them."""
    counts = tokens.filter(F.col("word").isNotNull()).select("word", "df")
    pairs = counts.agg(F.sum(F.aggregate("df", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    by_word = counts.select(F.inline(F.arrays_zip("word", "df")).alias("word", "df")).groupBy("word").agg(F.sum("df").alias("df"))
    found = by_word.filter(F.col("df") >= max(math.ceil(pairs / most_frequent), 3)).toPandas()
    order = np.argsort(found["word"].to_numpy(np.int64))
    return found["word"].to_numpy(np.int64)[order], found["df"].to_numpy(np.int64)[order]


def keyed(tokens: DataFrame, frequent) -> DataFrame:
    """key, row, doc_id, ids, n of the documents. frequent: a broadcast array of hashes, ascending."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frequent.value
        for batch in batches:
            sketch = batch.column("sketch")
            flat, bounds = sketch.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(sketch).to_numpy())))
            at = np.searchsorted(words, flat)
            rare = np.flatnonzero(words[np.minimum(at, max(len(words) - 1, 0))] != flat) if len(words) else np.arange(len(flat))
            first = np.searchsorted(rare, bounds[:-1])
            best = rare[np.minimum(first, len(rare) - 1)] if len(rare) else np.zeros(len(batch), np.int64)
            best = np.where((first < len(rare)) & (best < bounds[1:]), best, bounds[:-1])  # no rare word: the least hash
            padded = np.concatenate((flat, [0]))
            key = np.where(bounds[1:] > bounds[:-1], padded[np.minimum(best, len(flat))], 0)
            key = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # long texts have the least hashes: spread them
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[batch.column(c) for c in ("row", "doc_id", "ids", "n")]], ["key", "row", "doc_id", "ids", "n"])

    return tokens.filter(F.col("ids").isNotNull()).select("row", "doc_id", "ids", "n", "sketch").mapInArrow(choose, "key long, row long, doc_id long, ids binary, n long")


class Shard:
    """A BM25 inverted index over units: postings by word, unit lengths, and which units are still unused."""

    K1, B = 1.2, 0.75

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], docs: int, mean_words: float):
        unit, word, counts = _terms(ids, lengths, ends)
        self.units = len(lengths)
        length = np.bincount(unit, weights=counts, minlength=self.units)
        order = np.argsort(word, kind="stable")
        by_word = word[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(len(by_word), 1), bool), by_word[1:] != by_word[:-1])))
        held = np.diff(np.concatenate((start, [len(by_word)])))  # units that hold each distinct word
        distinct, df = by_word[start], held.astype(np.float64)
        if len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], distinct), len(frequent[0]) - 1)
            df = np.maximum(df, np.where(frequent[0][at] == distinct, frequent[1][at], 0))
        idf = np.log1p((max(docs, self.units) - df + 0.5) / (df + 0.5))
        code = np.empty(len(word), np.int64)
        code[order] = np.repeat(np.arange(len(start)), held)
        asked = (held[code] > 1) & (held[code] <= max(self.units / 2, 2))
        self.query, self.query_bounds = code[asked], np.searchsorted(unit[asked], np.arange(self.units + 1))
        scores = idf[code] * counts * (self.K1 + 1) / (counts + self.K1 * (1 - self.B + self.B * length[unit] / max(mean_words, 1)))
        self.start, self.held, self.posting_unit, self.posting_score = start, held, unit[order], scores[order]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused units that share an asked word with the seed, best first."""
        words = self.query[self.query_bounds[seed] : self.query_bounds[seed + 1]]
        many = self.held[words]
        upto = np.cumsum(many)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.start[words] - upto + many, many)
        scores = np.bincount(self.posting_unit[at], weights=self.posting_score[at], minlength=self.units) * unused
        found = np.flatnonzero(scores > 0)
        first = found[np.argpartition(-scores[found], 32)[:32]] if len(found) > 32 else found
        yield from first[np.lexsort((first, -scores[first]))].tolist()
        if len(first) < len(found):
            rest = np.setdiff1d(found, first)
            yield from rest[np.lexsort((rest, -scores[rest]))].tolist()


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = 1 << 18, sketch: int = 16, shard_units: int = 2048, batch_rows: int = 2_000) -> DataFrame:
    """The pieces of all documents: PIECES. sequence_id is unique; offsets in a sequence have no gaps. All sequences are
    ``window`` long, but for the last of the corpus, whose tokens are dealt to sequences of its largest powers of two."""
    spark = docs.sparkSession
    with arrow_batches(spark, batch_rows):
        tokens = stored(tokenised(docs, path, end_id, sketch, id_col, text_col), "tokens")
    n_docs, words = tokens.filter(F.col("ids").isNotNull()).agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean_words, known = words / max(n_docs, 1), frequent_words(tokens, most_frequent)
    frequent, frequencies = spark.sparkContext.broadcast(known[0]), spark.sparkContext.broadcast(known[1])  # most_frequent numbers at most

    def pack(round_: int, final: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            ends, sequence = word_ends(path, end_id), ((round_ << 22) + TaskContext.get().partitionId()) << 36
            _pieces(path).forget()  # this worker's memo isn't needed any more

            def shard(units: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
                nonlocal sequence
                bodies = [u[1][u[2] : u[2] + u[3]] for u in units]
                lengths = np.array([len(b) for b in bodies], dtype=np.int64)
                index = Shard(np.concatenate(bodies), lengths, ends, (frequent.value, frequencies.value), n_docs, mean_words)
                start, left = np.array([u[2] for u in units]), lengths.copy()
                unused, order, out, turn = np.ones(len(units), bool), np.argsort(-left, kind="stable").tolist(), [], 0
                total = int(left.sum())
                while total >= window or (last and total):
                    while not unused[order[turn]]:
                        turn += 1
                    seed, offset = order[turn], 0

                    def take(u: int) -> None:
                        nonlocal offset, total
                        length = int(min(left[u], window - offset))
                        out.append((units[u], int(start[u]), length, sequence, offset))
                        start[u] += length
                        left[u] -= length
                        offset, total = offset + length, total - length
                        unused[u] = left[u] > 0

                    take(seed)
                    if offset < window and total:
                        for u in index.neighbours(seed, unused):
                            take(u)
                            if offset == window:
                                break
                    ahead = turn
                    while offset < window and total:  # no neighbour is left: go on with the next unused units
                        while not unused[order[ahead]]:
                            ahead += 1
                        take(order[ahead])
                    sequence += 1
                return out, [(u[0], u[1], int(s), int(k), u[4], u[5]) for u, s, k in zip(units, start, left, strict=True) if k]

            def binary(pieces: list[tuple]) -> Iterator[tuple]:
                """The corpus's last sequence, cut into sequences whose lengths are powers of two: none of them is padded."""
                nonlocal sequence
                whole, room, used = sum(p[2] for p in pieces), 0, 0
                for unit, start, length, _, _ in pieces:
                    while length:
                        if not room:
                            sequence += 1
                            room, used = 1 << (whole.bit_length() - 1), 0
                            whole -= room
                        size = min(length, room)
                        yield unit, start, size, sequence, used
                        start, length, room, used = start + size, length - size, room - size, used + size

            def frame(pieces: list[tuple], rest: list[tuple] = ()) -> pd.DataFrame:
                rows = [(u[0], u[5] + s, k, zlib.crc32(u[1][s : s + k].astype("<u4").tobytes()), u[4], q, o, None) for u, s, k, q, o in pieces]
                rows += [(u[0], u[5] + u[2], u[3], 0, u[4], -1, -1, u[1][u[2] : u[2] + u[3]].tobytes()) for u in rest]
                return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": "Int64"})

            waiting: list[tuple] = []  # units: (doc_id, ids, start and length of what is left of them, doc_tokens, place of the ids in the document)
            for batch in batches:
                out = []
                for doc_id, buffer, before, tokens_ in zip(batch["doc_id"], batch["ids"], batch["start"].tolist(), batch["doc_tokens"].tolist(), strict=True):
                    ids = np.frombuffer(buffer, dtype="<u2")
                    full = len(ids) - len(ids) % window
                    unit = (None if pd.isna(doc_id) else int(doc_id), ids, full, len(ids) - full, tokens_, before)
                    for start in range(0, full, window):
                        out.append((unit, start, window, sequence, 0))
                        sequence += 1
                    if unit[3]:
                        waiting.append(unit)
                    if len(waiting) >= shard_units:
                        made, waiting = shard(waiting, False)
                        out += made
                yield frame(out)
            if waiting:
                made, rest = shard(waiting, final)
                tail = [m for m in made if m[3] == made[-1][3]] if final else []
                if tail and sum(m[2] for m in tail) < window:
                    made = made[: -len(tail)] + list(binary(tail))
                yield frame(made, rest)

        return work

    partitions = max(1, math.ceil(n_docs / (4 * shard_units)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_docs / 256)))
    units = keyed(tokens, frequent).repartitionByRange(partitions, "key", "row").sortWithinPartitions("key", "row")
    units, done, round_ = units.select("doc_id", "ids", F.lit(0).cast("long").alias("start"), F.col("n").alias("doc_tokens")), None, 0
    while True:
        now = stored(units.mapInPandas(pack(round_, partitions == 1), PIECES + ", ids binary"), "packed")
        if not round_:
            dropped(tokens)
        made = now.filter("sequence_id >= 0").drop("ids")
        done = made if done is None else done.unionByName(made)
        if partitions == 1:
            return done
        partitions, round_ = math.ceil(partitions / 64), round_ + 1
        units = now.filter("sequence_id < 0").select("doc_id", "ids", "start", "doc_tokens").repartition(partitions)
