"""Near duplicates (operator 9): order MinHash, verified by banded alignment.

A text's elements are its occurrence-labelled k-mers of words (the second time a k-mer occurs, it is another element).
Each of ``sketches`` hash functions picks the ``picked`` elements with the smallest values and keeps them *in the order of
the text*: two texts agree there only if they share these elements in the same order, so agreement follows edit
similarity. Texts that agree in a sketch share a bucket.

Verification aligns two element sequences within a band: elements match one to one (they are distinct), matches off the
diagonal by more than the band are dropped, and the longest increasing run of matches is the alignment's length m. The
similarity is m / (a + b - m), an order-sensitive Jaccard coefficient; links need ``threshold``. The band is as wide as
the unmatched elements that the threshold leaves room for, so it loses no link.

Groups: exact copies (same words) are one node from the start. In a first round, each bucket's least row is its hub, and
every other member is aligned with it; links merge classes. What is left are pairs of other members in different
classes. Each of them is compared (``rest``), in blocks of at most about ``block`` texts: the largest class of a bucket is
held against the others, the others against each other. Within a pair of blocks, elements in common are counted first,
and only pairs whose count could reach the threshold, and that no link has joined yet, are aligned. So two texts that
share a bucket and are similar enough are always in one class.

In a bucket where ``rest`` would compare more than ``cheap`` pairs a member, ``hubs`` members more, drawn anew for each
bucket, are tried first, as long as this halves the pairs. This saves comparisons and leaves none out.

Classes are connected components, by contraction: each node points at its least neighbour, pointers are doubled up to the
roots, edges are relabelled, until none is left. All of this is done by joins; nothing that grows with the corpus reaches the driver or a single task.

Hot keys: a class or a group of copies may hold much of the corpus; joins by them broadcast the few largest keys
(``split_join``), so that their rows stay where they are.

Defined results: texts without words (null, empty) are classes of their own; repeated rows are copies; the class id is
the least id in the class; an empty table gives an empty table; a very long text is sketched and aligned whole, and
makes small blocks; columns named in ``keep`` pass through, whatever their names, but for those of the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, dropped, shared_dir, split_join, stored

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT, _LARGEST = np.uint64(31), np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> _SHIFT)


def elements(words: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The labelled k-mers of several texts, in order, and where each text's begin (one more bound at the end). A text under k words is one k-mer."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    flat = np.concatenate([*words, np.zeros(k, np.uint32)]).astype(np.uint64) + np.uint64(1)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.repeat(np.arange(len(words)), counts)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(begin, counts)
    room = np.repeat(np.minimum(sizes, k), counts)
    hashes = np.zeros(bounds[-1], np.uint64)
    for i in range(k):
        hashes = _mixed(hashes * _A + np.where(i < room, flat[at + i], np.uint64(0)))
    order = np.lexsort((hashes, owner))
    ordered, same = hashes[order], np.zeros(len(order), bool)
    same[1:] = (ordered[1:] == ordered[:-1]) & (owner[order][1:] == owner[order][:-1])
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        labelled = np.empty_like(hashes)
        labelled[order] = np.where(run > 0, _mixed(ordered + run.astype(np.uint64) * _A), ordered)
        hashes = labelled
    return hashes, bounds


def order_min_hash(words: list[np.ndarray], k: int, sketches: int, picked: int) -> list[np.ndarray]:
    """The bucket keys of each text: one a sketch; none for a text without words."""
    labels, bounds = elements(words, k)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    here = np.flatnonzero(np.diff(bounds))
    if not len(here):
        return out
    first, counts = bounds[here], np.diff(bounds)[here]
    keys = np.empty((len(here), sketches), np.uint64)
    for j in range(sketches):
        values = _mixed(labels * _A + np.uint64((2 * j + 1) * int(_C) & 0xFFFFFFFFFFFFFFFF))
        places = np.full((len(here), picked), len(labels), np.int64)
        for p in range(picked):
            least = np.minimum.reduceat(values, first)
            found = np.flatnonzero(values == np.repeat(least, counts))
            owner = np.searchsorted(first, found, side="right") - 1
            found = found[least[owner] != _LARGEST]
            owner = np.searchsorted(first, found, side="right") - 1
            places[owner[::-1], p] = found[::-1]
            values[found] = _LARGEST
        places.sort(axis=1)
        key = np.full(len(here), np.uint64(j + 1))
        padded = np.concatenate((labels, [np.uint64(0)]))
        for p in range(picked):
            key = _mixed(key * _A + padded[places[:, p]])
        keys[:, j] = key
    for i, text in enumerate(here.tolist()):
        out[text] = keys[i].view(np.int64)
    return out


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two sequences of distinct elements by banded alignment; exact where it reaches the threshold."""
    if not len(a) or not len(b):
        return 0.0
    union = (len(a) + len(b)) / (1 + threshold)  # the most elements that two sequences this long have, if they reach the threshold
    band = int(union * (1 - threshold)) + 1
    order = np.argsort(b)
    place = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    to = order[place]
    i = np.flatnonzero(b[to] == a)
    j = to[i]
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    else:
        m = len(j)
    return m / (len(a) + len(b) - m)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component. edges: a, b."""
    labels = nodes.select("node", F.col("node").alias("label"))
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().checkpoint()
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("to")).union(left.select(F.col("a").alias("node"), F.col("b").alias("to")))
        parents = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")).checkpoint()
        while True:  # up to the roots, so that a chain costs the logarithm of its length
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parents = parents.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), (F.col("top") < F.col("parent")).alias("moved")).checkpoint()
            if parents.filter("moved").isEmpty():
                break
        moved = parents.select(F.col("node").alias("label"), "parent")
        labels = labels.join(moved, "label", "left").select("node", F.coalesce("parent", "label").alias("label")).checkpoint()
        ends = left.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        left = ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct().checkpoint()
    return labels


def aligned(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """pairs (a, b) with their similarity. texts: row, w."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, y in zip(batch["wa"], batch["wb"], strict=True):
                labels, bounds = elements([np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")], k)
                found.append(alignment(labels[: bounds[1]], labels[bounds[1] :], threshold))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": found})

    left, right = texts.select(F.col("row").alias("a"), F.col("w").alias("wa")), texts.select(F.col("row").alias("b"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInPandas(align, "a long, b long, similarity double")


def linked(rows: np.ndarray, classes: np.ndarray, left: np.ndarray, right: np.ndarray, labels: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts at the places left and right (disjoint, or the same) that join all classes which any pair links.
    The elements of the text at place i are ``labels[bounds[i]:bounds[i + 1]]``."""
    sizes, n = np.diff(bounds), len(rows)
    _, codes = np.unique(labels[bounds[0] : bounds[-1]], return_inverse=True)
    offset, same = bounds - bounds[0], left is right
    holder = np.repeat(np.arange(n), sizes)
    held = np.flatnonzero(np.isin(holder, right))
    held = held[np.argsort(codes[held], kind="stable")]
    posting, start = holder[held], np.concatenate(([0], np.cumsum(np.bincount(codes[held], minlength=codes.max(initial=-1) + 1))))
    _, first, of_class = np.unique(classes, return_index=True, return_inverse=True)
    parent = first[of_class].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in left.tolist():
        mine = codes[offset[i] : offset[i + 1]]
        begin, many = start[mine], start[mine + 1] - start[mine]
        at = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
        common = np.bincount(posting[at], minlength=n)
        for j in np.flatnonzero(common >= threshold * (sizes[i] + sizes - common) - 1e-6).tolist():
            if (j > i or not same) and common[j] and root(i) != root(j):
                if alignment(labels[bounds[i] : bounds[i + 1]], labels[bounds[j] : bounds[j + 1]], threshold) >= threshold:
                    parent[root(i)] = root(j)
                    out.append((int(rows[i]), int(rows[j])))
    return out


def rest(now: DataFrame, texts: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) that join all classes with a linked pair in a bucket. now: key, row, n (words), label."""
    words = 1_000 * block  # a block's words, so that long texts make small blocks
    by_class = now.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sums = by_class.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("m", "n", "label")).alias("most"), F.sum("m").alias("m"), F.sum("n").alias("n")).filter("classes > 1")
    blocks = lambda m, n: F.ceil(F.greatest(m / block, n / words)).cast("int")
    small = (F.col("m") <= block) & (F.col("n") <= words)
    few = F.when(small, F.lit(0)).otherwise(blocks(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.n")))
    sums = sums.select("key", F.col("most.label").alias("large"), few.alias("few"), F.when(small, F.lit(0)).otherwise(F.greatest(blocks(F.col("most.m"), F.col("most.n")), F.lit(1))).alias("many"))
    deal = lambda count: F.pmod(F.xxhash64("row", F.lit(29)), F.greatest(count, F.lit(1))).cast("int")
    placed = now.join(sums, "key").withColumn("of_large", F.col("label") == F.col("large"))
    placed = placed.withColumn("own", F.when(F.col("few") == 0, F.lit(0)).when(F.col("of_large"), F.col("few") + deal(F.col("many"))).otherwise(deal(F.col("few"))))
    last = F.when(F.col("few") == 0, F.lit(0)).when(F.col("of_large"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    dealt = placed.select("key", "row", "label", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "row", "label").join(texts, "row")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(part: pd.DataFrame, cuts: list[int]) -> Iterator[pd.DataFrame]:
            rows, classes, own, lo, hi = (part[c].to_numpy() for c in ("row", "label", "own", "lo", "hi"))
            at = 0
            while at < len(cuts) - 1:
                to = at + 1
                while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= 256:
                    to += 1
                labels, bounds = elements([np.frombuffer(w, "<u4") for w in part["w"].iloc[cuts[at] : cuts[to]]], k)
                found = []
                for g in range(at, to):
                    x, y = cuts[g], cuts[g + 1]
                    if (classes[x:y] != classes[x]).any():
                        left = np.flatnonzero(own[x:y] == lo[x])
                        right = left if lo[x] == hi[x] else np.flatnonzero(own[x:y] == hi[x])
                        found += linked(rows[x:y], classes[x:y], left, right, labels, bounds[x - cuts[at] : y - cuts[at] + 1], threshold)
                yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
                at = to

        held = None
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(part):
                continue
            ids = part[["key", "lo", "hi"]].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
            yield from links(part, cuts)  # the last group may go on in the next batch
            held = part.iloc[cuts[-1] :]
        if held is not None:
            yield from links(held, [0, len(held)])

    group = ("key", "lo", "hi")
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), k: int = 5, threshold: float = 0.8, sketches: int = 16, picked: int = 3, hubs: int = 8, cheap: int = 2048, block: int = 256, batch_rows: int = 2_000) -> DataFrame:
    """One row a document: row (unique), id, the columns in keep, class_id (least id of its class), first (whether it is the class's first row)."""
    shared_dir(docs.sparkSession)  # checkpoint() needs it set
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.hash(w))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                lists = [np.asarray(w, dtype=np.int32).view(np.uint32) for w in part["w"]]
                keys = order_min_hash(lists, k, sketches, picked)
                yield pd.DataFrame({"row": part["row"], "n": [len(w) for w in lists], "h": part["h"], "g": part["g"], "keys": keys, "w": [w.tobytes() for w in lists], "id": part["id"]} | {c: part[c] for c in own})

    own = [f"_keep{i}" for i in range(len(keep))]  # so that no kept column clashes with a working one
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w"), *[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)])
    hashed = named.withColumns({"h": F.xxhash64("w"), "g": F.xxhash64(F.lit(1), "w")})
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f", {o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(keep, own, strict=True))
    with arrow_batches(docs.sparkSession, batch_rows):
        table = stored(hashed.mapInPandas(sketch, f"row long, n int, h long, g long, keys array<long>, w binary, id {id_type}{kept}"), "sketches")

    # exact copies: one node; texts without words: a node each
    narrow = table.select("row", "n", "h", "g", F.when(F.col("n") == 0, F.col("row")).otherwise(F.lit(-1)).alias("alone"))
    copies = narrow.groupBy("h", "g", "n", "alone").agg(F.min("row").alias("node"))
    of_node = split_join(narrow, copies, ["h", "g", "n", "alone"]).select("row", "node").checkpoint()
    nodes = of_node.filter("row = node").select("node")
    buckets = table.select("row", "n", F.explode("keys").alias("key")).join(nodes, F.col("row") == F.col("node"), "left_semi")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = stored(buckets.join(shared, "key"), "buckets")
    labels = members.select(F.col("row").alias("node")).distinct().select("node", F.col("node").alias("label")).checkpoint()
    texts = stored(table.join(labels, F.col("row") == F.col("node"), "left_semi").select("row", "w"), "texts")

    def merged(links: DataFrame) -> DataFrame:
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        joined = components(labels.select(F.col("label").alias("node")).distinct(), ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        return split_join(labels, joined.select(F.col("node").alias("label"), F.col("label").alias("new")), ["label"]).select("node", F.col("new").alias("label")).checkpoint()

    def near(pairs: DataFrame) -> DataFrame:
        return aligned(pairs, texts, k, threshold).filter(F.col("similarity") >= threshold).select("a", "b").checkpoint()

    least = members.groupBy("key").agg(F.min("row").alias("hub"))
    links = near(members.join(least, "key").filter("row <> hub").select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct())
    if not links.isEmpty():
        labels = merged(links)
    others = members.join(least, "key").filter("row <> hub").drop("hub")  # each was compared with the least row
    last, seed = None, 0
    while True:
        now = others.join(labels, F.col("row") == F.col("node")).select("key", "row", "n", "label")
        by_class = now.groupBy("key", "label").agg(F.count("*").alias("m"))
        crossing = by_class.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("s")).select("key", ((F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs"), "m")
        large = crossing.filter(F.col("pairs") > cheap * F.col("m"))
        pairs = large.agg(F.sum("pairs")).first()[0]
        if not pairs or (last is not None and pairs > last / 2):
            break
        here = now.join(large.select("key"), "key")
        picks = F.array(*[F.min(F.struct(F.xxhash64("row", "key", F.lit(seed + i)).alias("pick"), "row", "label")) for i in range(hubs)])
        drawn = here.groupBy("key").agg(F.array_distinct(F.transform(picks, lambda p: F.struct(p.row.alias("hub"), p.label.alias("hub_label")))).alias("picks")).select("key", F.inline("picks"))
        links = near(here.join(drawn, "key").filter("label <> hub_label").select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct())
        if links.isEmpty():
            break
        labels, last, seed = merged(links), pairs, seed + hubs
    links = rest(now, texts, k, threshold, block).distinct().checkpoint()
    if not links.isEmpty():
        labels = merged(links)
    classes = of_node.join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("class"))
    whole = table.select("row", "id", *own).join(classes, "row").checkpoint()
    ids = whole.groupBy("class").agg(F.min("id").alias("class_id"), F.min("row").alias("first_row"))
    named_back = [F.col(o).alias(c) for c, o in zip(keep, own, strict=True)]
    out = split_join(whole, ids, ["class"]).select("row", F.col("id").alias(id_col), *named_back, "class_id", (F.col("row") == F.col("first_row")).alias("first")).checkpoint()
    dropped(table)
    dropped(members)
    dropped(texts)
    return out
