"""Near-duplicate titles against all history: a stored index of kept titles that each batch asks and extends.

The rule is sequential: a title goes where the matcher's ratio with any kept earlier title reaches the threshold. A ratio
2 m / (a + b) >= t means that m characters of both titles match, in at most a + b - 2 m + 1 runs. So two such titles have at least m
letters in common, whatever their places, and at least m less two a run of their triples. ``compared`` counts common letters of all pairs of titles
of fitting lengths, block by block (a few machine operations a pair, no shuffle of pairs), common triples of what is left, and how long the longest
common subsequence of what is left then is, which the matcher can't exceed; only what passes all three meets the matcher. Letters and triples are counted in
buckets, which can only add to what two titles have in common, so no pair is lost.

``met`` finds the same pairs by a join on segments: a title is cut into one more segment than the characters that any title so alike can leave
unmatched. It suits few or very different titles; where titles share their syllables, short segments are everywhere.

The index only grows by kept titles. It is Parquet, appended once a batch, when decisions are already stored; a batch that is added again
is decided again (its kept titles are found in the index as duplicates). The work of a batch grows with its titles times those kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..sources.files import stored
from .dedupe import greedy, normalised

_INDEX = T.StructType([T.StructField("o", T.LongType()), T.StructField("t", T.StringType())])

#: Titles of a block at most, pairs compared at once, buckets of letters and of triples, counts of a group of letters at most,
#: titles of several lengths that go together.
BLOCK, AT_ONCE, LETTERS, TRIPLES, COMBINED, RUN = 16_384, 1 << 21, 32, 256, 256, 1_024


def _sizes(length: Column, threshold: float) -> tuple[Column, Column]:
    """Segments of a title, and their least length; the first ones are one longer, until the title is used up."""
    lost = F.floor(2 * length * (1 - threshold) / threshold + 1e-9)
    count = F.greatest(F.least(lost + 1, length), F.lit(1))
    return count, F.floor(length / count)


def segments(titles: DataFrame, threshold: float) -> DataFrame:
    """(o, t, n, at, seg): the segments of each title with their places, from 1. titles: o, t (not empty)."""
    n = F.length("t").cast("long")
    count, least = _sizes(F.col("n"), threshold)
    cut = titles.select("o", "t", n.alias("n")).withColumns({"count": count.cast("long"), "least": least.cast("long")}).withColumn("longer", F.col("n") - F.col("count") * F.col("least"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i")
    at = F.col("i") * F.col("least") + F.least("i", "longer") + 1
    size = F.col("least") + (F.col("i") < F.col("longer")).cast("long")
    return cut.select("o", "t", "n", "least", "longer", i).select("o", "t", "n", at.alias("at"), F.expr("substring(t, CAST(i * least + least(i, longer) + 1 AS INT), CAST(least + CAST(i < longer AS INT) AS INT))").alias("seg"), size.alias("size")).drop("size")


def probes(titles: DataFrame, threshold: float) -> DataFrame:
    """(o, t, n, at, seg): the substrings of each title that could be a segment of a title as alike as the threshold."""
    n = F.length("t").cast("long")
    low, high = F.ceil(n * threshold / (2 - threshold) - 1e-9), F.floor(n * (2 - threshold) / threshold + 1e-9)
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(low, F.lit(1).cast("long")), high), lambda b: let(_sizes(b, threshold)[1].cast("int"), lambda s: F.array(s, s + 1)))))
    spread = titles.select("o", "t", n.alias("n"), F.explode(sizes).alias("size")).filter("size <= n")
    return spread.select("o", "t", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("size") + 1)).alias("at"), "size").withColumn("seg", F.expr("substring(t, CAST(at AS INT), size)")).drop("size")


def alike(new: str, seen: str, threshold: float) -> float:
    """The ratio, or 0 where the letters of both already show that it stays below the threshold."""
    both = sum((Counter(new) & Counter(seen)).values())
    return SequenceMatcher(None, new, seen).ratio() if 2 * both >= threshold * (len(new) + len(seen)) - 1e-9 else 0.0


def met(asking: DataFrame, index: DataFrame, threshold: float, earlier: bool = False) -> DataFrame:
    """(later, earlier, ratio) of pairs at least as alike as the threshold. earlier: only with rows of the index that come before (o)."""
    a, b = asking.alias("a"), index.alias("b")
    total = F.col("a.n") + F.col("b.n")
    shift, more = F.col("a.at") - F.col("b.at"), F.col("a.n") - F.col("b.n")
    fits = (2 * F.least("a.n", "b.n") >= threshold * total - 1e-9) & (F.abs(shift) + F.abs(shift - more) <= (1 - threshold) * total + 1e-9)
    on = (F.col("a.seg") == F.col("b.seg")) & fits
    pairs = a.join(b, on & (F.col("b.o") < F.col("a.o")) if earlier else on).select(F.col("a.o").alias("later"), F.col("b.o").alias("earlier"), F.col("a.t").alias("new"), F.col("b.t").alias("seen")).distinct()

    @F.pandas_udf(T.DoubleType())
    def ratio(new: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, threshold) for x, y in zip(new, seen, strict=True)], dtype=float)

    return pairs.withColumn("ratio", ratio("new", "seen")).filter(F.col("ratio") >= threshold).select("later", "earlier", "ratio")


def signatures(titles: list[str]) -> tuple[np.ndarray, ...]:
    """Lengths, how many letters and triples of each title fall into each bucket, and its letters as bytes (padded by zeros, like letters like bytes; of width 0 beside very
    long titles)."""
    sizes = np.array([len(t) for t in titles], np.int64)
    code = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(titles)), sizes)
    kind = np.uint8 if sizes.max(initial=0) < 256 else np.uint32
    counted = lambda rows, keys, n: np.bincount(rows * n + keys % n, minlength=len(titles) * n).reshape(-1, n).astype(kind)
    whole = row[2:] == row[:-2]
    triples = (code[:-2] * 1_000_003 + code[1:-1] * 8_191 + code[2:] * 31)[whole]
    spelt = np.zeros((len(titles), sizes.max(initial=0) if kind is np.uint8 else 0), np.uint8)
    if spelt.size:
        spelt[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = 2 + code % 254
    return sizes, counted(row, code, LETTERS), counted(row[2:][whole], triples ^ (triples >> 9), TRIPLES), spelt


def _least(total: np.ndarray, threshold: float) -> np.ndarray:
    """Characters that match at least where the ratio of two titles of this length together reaches the threshold."""
    return np.ceil(threshold * total / 2 - 1e-9)


def _grouped(letters: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Letters in groups that occur with at most COMBINED counts: which letters, a row that stands for each of its counts, and which of these each row has."""
    out: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for k in sorted(np.flatnonzero(letters.any(axis=0)).tolist(), key=lambda k: len(np.unique(letters[:, k]))):
        own = letters[:, k].astype(np.int64)
        if out:
            _, at, which = np.unique(out[-1][2] * (1 + int(own.max())) + own, return_index=True, return_inverse=True)
            if len(at) <= COMBINED:
                out[-1] = ([*out[-1][0], k], at, which)
                continue
        out.append(([k], *np.unique(own, return_index=True, return_inverse=True)[1:]))
    return out


def _of_like_letters(new: tuple[np.ndarray, ...], seen: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs with enough letters in common. What a group of letters adds is looked up in a table of its counts against all titles seen, so a pair costs an
    addition a group."""
    (n, letters), (m, others) = new[:2], seen[:2]
    across = np.ascontiguousarray(others.T)
    wide = np.promote_types(letters.dtype, others.dtype)
    first = last = 0
    while last < len(n):  # a run of titles: those of a length, or of several lengths that few titles have
        first, end = last, min(last + RUN, len(n)) - 1
        last = int(np.searchsorted(n, n[end], "left" if n[end] > n[first] else "right"))
        low, high = np.searchsorted(m, [np.ceil(n[first] * threshold / (2 - threshold) - 1e-9), np.floor(n[last - 1] * (2 - threshold) / threshold + 1e-9) + 1])
        if low == high:
            continue
        needs = {size: _least(size + m[low:high], threshold).astype(wide) for size in np.unique(n[first:last]).tolist()}
        need = [needs[size] for size in n[first:last].tolist()]
        part, tables = letters[first:last], []
        for group, at, which in _grouped(part):
            table = np.zeros((len(at), high - low), wide)
            for k in group:
                values, place = np.unique(part[at, k], return_inverse=True)
                table += np.minimum(np.repeat(values[:, None], high - low, axis=1), across[k, low:high])[place]
            tables.append([table[i] for i in which.tolist()])
        both, step = np.empty(high - low, wide), max(1, AT_ONCE // (high - low))
        hits = np.zeros((step, -(-(high - low) // 8) * 8), bool)
        for at in range(0, last - first, step):
            count = min(step, last - first - at)
            for i in range(count):
                total = tables[0][at + i]
                for table in tables[1:]:
                    total = np.add(total, table[at + i], both)
                np.greater_equal(total, need[at + i], hits[i, : high - low])
            eights = np.flatnonzero(hits[:count].view(np.uint64))
            x, y = np.nonzero(hits.reshape(-1, 8)[eights])
            i, j = np.divmod(eights[x] * 8 + y, hits.shape[1])
            yield i + at + first, j + low


def longest_common(new: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How long the longest common subsequence of each pair of titles (spelt as in ``signatures``) is: bits of words a title, a step a letter of the other, many
    pairs at once."""
    width = -(-new.shape[1] // 64) * 64
    padded = np.zeros((len(new), width), np.uint8)
    padded[:, : new.shape[1]] = new
    seen = np.where(seen == 0, 1, seen).astype(np.uint8)  # padding is like nothing
    rest = np.full((len(new), width // 64), ~np.uint64(0))
    for t in range(seen.shape[1]):
        same = np.packbits(padded == seen[:, t, None], axis=1, bitorder="little").view(np.uint64) & rest
        carry = np.zeros(len(new), np.uint64)
        for w in range(rest.shape[1]):
            old = rest[:, w]
            up = old + same[:, w]
            total = up + carry
            carry = ((up < old) | (total < up)).astype(np.uint64)
            rest[:, w] = total | (old & ~same[:, w])
    return width - np.bitwise_count(rest).sum(axis=1, dtype=np.int64)


def candidates(new: tuple[np.ndarray, ...], seen: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of titles (by their signatures, lengths rising) that can be as alike as the threshold."""
    (n, _, triples, spelt), (m, _, their, others) = new, seen
    waits: list[tuple[np.ndarray, np.ndarray]] = []

    def settled() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*waits, strict=True))
        waits.clear()
        if spelt.shape[1] and others.shape[1]:
            fits = longest_common(spelt[a], others[b]) >= _least(n[a] + m[b], threshold)
            a, b = a[fits], b[fits]
        return a, b

    for i, j in _of_like_letters(new, seen, threshold):
        for x in range(0, len(i), 1 << 13):
            a, b = i[x : x + (1 << 13)], j[x : x + (1 << 13)]
            total = n[a] + m[b]
            fits = np.minimum(triples[a], their[b]).sum(axis=1, dtype=np.int64) >= 5 * _least(total, threshold) - 2 * total - 2
            waits.append((a[fits], b[fits]))
            if sum(len(w[0]) for w in waits) >= 1 << 12:
                yield settled()
    if waits:
        yield settled()


def blocks(titles: DataFrame) -> DataFrame:
    """Titles (o, t) in blocks of about BLOCK or, of few titles, an eighth of them: orders and signatures as bytes, by rising length. Very long titles have blocks of their own."""
    total = titles.count()
    size = min(BLOCK, max(256, total // 8 + 1))
    count = total // size + 1

    def packed(group: pa.Table) -> pa.Table:
        texts = group.column("t").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        sizes, *rest = signatures([texts[i] for i in order])
        data = [group.column("o").to_numpy()[order], sizes, *rest]
        return pa.table({"block": group.column("block").slice(0, 1), "kind": [rest[0].dtype.str], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip("onlps", data, strict=True)}})

    dealt = titles.select("o", "t", (F.pmod(F.xxhash64("t"), F.lit(count)) * 2 + (F.length("t") > 255).cast("long")).alias("block"))
    made = stored(dealt.groupBy("block").applyInArrow(packed, "block long, kind string, o binary, n binary, l binary, p binary, s binary"), "title_blocks")
    tasks = min(16, count)
    return made.repartitionById(tasks, F.expr(f"CAST(pmod(block div 2, {tasks}) AS INT)"))


def compared(asking: DataFrame, seen: DataFrame, threshold: float, earlier: bool = False) -> DataFrame:
    """(later, earlier, ratio) of pairs of titles (o, t; not empty, o once a side) at least as alike as the threshold. earlier: only with those seen that come before (o)."""
    own = asking is seen and earlier  # a pair of blocks meets once
    made = blocks(asking)
    a, b = (x.select(*[F.col(c).alias(f"{c}{i}") for c in ("block", "kind", "o", "n", "l", "p", "s")]) for i, x in enumerate((made, made if own else blocks(seen))))

    def read(batch: pa.RecordBatch, row: int, side: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        get = lambda c, kind: np.frombuffer(batch.column(f"{c}{side}")[row].as_buffer(), kind)
        kind, n = batch.column(f"kind{side}")[row].as_py(), get("n", np.int64)
        return get("o", np.int64), (n, get("l", kind).reshape(-1, LETTERS), get("p", kind).reshape(-1, TRIPLES), get("s", np.uint8).reshape(len(n), -1))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (o, new), (k, old) = read(batch, row, 0), read(batch, row, 1)
                crossed = own and batch.column("block0")[row] != batch.column("block1")[row]
                for i, j in candidates(new, old, threshold):
                    later, before = o[i], k[j]
                    if crossed:  # either may be the earlier one
                        later, before = np.maximum(later, before), np.minimum(later, before)
                    asked = before < later if earlier else np.ones(len(i), bool)
                    if asked.any():
                        yield pa.RecordBatch.from_pydict({"later": later[asked], "earlier": before[asked]})

    met_once = a.join(b, F.col("block0") <= F.col("block1")) if own else a.crossJoin(b)
    found = met_once.mapInArrow(pairs, "later long, earlier long")
    texts = found.join(asking.select(F.col("o").alias("later"), F.col("t").alias("new")), "later").join(seen.select(F.col("o").alias("earlier"), F.col("t").alias("seen")), "earlier")

    @F.pandas_udf(T.DoubleType())
    def ratio(new: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, threshold) for x, y in zip(new, seen, strict=True)], dtype=float)

    return texts.withColumn("ratio", ratio("new", "seen")).filter(F.col("ratio") >= threshold).select("later", "earlier", "ratio")


class TitleIndex:
    """Kept titles under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.9):
        self.spark, self.path, self.threshold = spark, path, threshold

    def index(self) -> DataFrame:
        """All kept titles (o, t); empty before the first batch."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(_INDEX).parquet(self.path) if there else self.spark.createDataFrame([], _INDEX)

    def add(self, batch: DataFrame, order: str, title_col: str = "title") -> DataFrame:
        """A row a row of the batch: order (a unique long; earlier rows come first), kept, and duplicate_of (the first kept title, by order, that it is too
        alike to). Blank titles are kept and never compared. Titles that are kept enter the index."""
        rows = stored(batch.select(F.col(order).cast("long").alias("o"), normalised(F.col(title_col)).alias("t")), "title_batch")
        firsts = stored(rows.filter("t <> ''").groupBy("t").agg(F.min("o").alias("o")), "title_firsts")
        before = self.index()
        known = compared(firsts, before, self.threshold).groupBy("later").agg(F.min("earlier").alias("earlier"))
        known = stored(known, "title_history")
        left = stored(firsts.join(known, F.col("o") == F.col("later"), "left_anti").select("o", "t"), "title_new")
        own = stored(compared(left, left, self.threshold, earlier=True), "title_pairs")
        gone = stored(greedy(own), "title_dropped")
        dropped = own.join(gone, F.col("later") == F.col("dropped"), "left_semi").join(gone.select(F.col("dropped").alias("earlier")), "earlier", "left_anti").groupBy("later").agg(F.min("earlier").alias("earlier"))
        decided = known.unionByName(dropped)
        by_title = firsts.join(decided, F.col("o") == F.col("later"), "left").select("t", F.col("o").alias("first"), "earlier")
        out = rows.join(by_title, "t", "left").select("o", F.coalesce("earlier", F.when(F.col("o") != F.col("first"), F.col("first"))).alias("duplicate_of"), "t")
        out = stored(out, "title_decisions")
        kept = out.filter("duplicate_of IS NULL AND t <> ''").select("o", "t")
        kept.write.mode("append").parquet(self.path)
        return out.select(F.col("o").alias(order), F.col("duplicate_of").isNull().alias("kept"), "duplicate_of")
