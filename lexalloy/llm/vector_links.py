"""Near-duplicate vectors by an epsilon grid order join: links at a cosine, their components, one kept a component.

Unit vectors have a cosine of at least t where their distance is at most eps = sqrt(2 - 2 t). Vectors are sorted by the cells, of
side eps, of a grid on their leading principal coordinates (an orthonormal basis, so coordinates never overstate a distance),
and the sequence is cut into tiles of a bounded number of bytes. Pairs of intervals of the sequence are joined from the whole sequence
down: intervals whose boxes lie more than eps apart are dropped with all pairs in them, others are replaced by the pairs of their
parts (joins on the parent's number), down to tiles; in a task the same goes on inside a pair of tiles, with balls around the means of
all dimensions, down to small blocks that are multiplied. A pair of blocks whose balls lie within eps of each other is
counted whole, so that a dense group doesn't cost the square of its size. Tasks return counts a vector and a spanning forest of
their links, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries link with nothing, nor do vectors of
another length than the commonest (of equally common ones the longest). Exact copies (equal entry for entry) are joined once, and each
links with all others. Repeated rows are vectors of their own. component_id is the least id reachable; null ids count in
links and are never a component's id (a component of null ids has a null id, and kept is null). An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, dropped, shared_dir, split_join, stored
from .near_duplicates import components
from .whitening import common_length, dense, summed, usable

#: Bytes of a tile (as float32; twice that where entries are doubles); vectors of a block that is multiplied; intervals that one is made of.
TILE_BYTES, LEAF, FAN = 1 << 20, 128, 8

#: Distances are computed with far smaller errors than this.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. Scaled by the largest entry first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Components of numbered vectors; keeps the links that joined them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        la, lb = int(self.label[a]), int(self.label[b])
        if la == lb:
            return
        self.links.append((a, b))
        xs, ys = self.members.pop(la, [la]), self.members.pop(lb, [lb])
        if len(xs) < len(ys):
            xs, ys, la = ys, xs, lb
        self.label[ys] = la
        self.members[la] = xs + ys

    def join_all(self, hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """hits: which of the vectors a (rows) and b (columns) link."""
        while True:
            apart = hits & (self.label[a][:, None] != self.label[b][None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return
            for i, j in zip(rows, apart[rows].argmax(axis=1), strict=True):
                self.join(int(a[i]), int(b[j]))


def joined_tiles(x: np.ndarray, y: np.ndarray | None, many: np.ndarray, others: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Links inside a tile (y is None) or between two: for each vector the copies it links with (itself not counted; the other tile's
    vectors are numbered on), a spanning forest of the links, and how many pairs were multiplied. many, others: copies of each vector."""
    reach = np.sqrt(2 - 2 * threshold)
    z, weight = (x, many) if y is None else (np.concatenate([x, y]), np.concatenate([many, others]))
    counts, forest, work = np.zeros(len(z), dtype=np.int64), Forest(len(z)), 0
    balls: dict[tuple[int, int], tuple[np.ndarray, float]] = {}

    def ball(lo: int, hi: int) -> tuple[np.ndarray, float]:
        if (lo, hi) not in balls:
            middle = z[lo:hi].mean(axis=0)
            balls[lo, hi] = middle, float(np.sqrt(((z[lo:hi] - middle) ** 2).sum(axis=1).max()))
        return balls[lo, hi]

    def halves(lo: int, hi: int) -> list[tuple[int, int]]:
        middle = (lo + hi) // 2
        return [(lo, middle), (middle, hi)] if hi - lo > LEAF else [(lo, hi)]

    stack = [((0, len(x)), (0, len(x)) if y is None else (len(x), len(z)))]
    while stack:
        a, b = stack.pop()
        (ma, ra), (mb, rb) = ball(*a), ball(*b)
        apart = float(np.sqrt(((ma - mb) ** 2).sum()))
        if apart - ra - rb > reach + SLACK:
            continue
        ia, ib = np.arange(*a), np.arange(*b)
        if (2 * ra if a == b else apart + ra + rb) < reach - SLACK:  # whatever the pair, it links
            counts[ia] += weight[ib].sum()
            if a == b:
                counts[ia] -= weight[ia]
            else:
                counts[ib] += weight[ia].sum()
            for j in ib[1:] if a == b else ib:
                forest.join(a[0], int(j))
            for i in ia[1:] if a != b else ():
                forest.join(int(i), b[0])
            continue
        pa_, pb_ = halves(*a), halves(*b)
        if len(pa_) + len(pb_) > 2:
            stack += [(p, q) for p in pa_ for q in pb_ if a != b or p <= q]
            continue
        cosines = z[a[0] : a[1]] @ z[b[0] : b[1]].T
        work += cosines.size
        hits = cosines >= threshold
        for i, j in np.argwhere(np.abs(cosines - threshold) < 1e-12):  # the same answer whatever the order of the sum
            hits[i, j] = float(np.sort(z[a[0] + i] * z[b[0] + j]).sum()) >= threshold
        if a == b:
            hits = hits | hits.T
            np.fill_diagonal(hits, False)
        if hits.any():
            counts[ia] += hits @ weight[ib]
            if a != b:
                counts[ib] += weight[ia] @ hits
            forest.join_all(hits, ia, ib)
    return counts, forest.links, work


def leading_axes(rows: DataFrame, d: int, dims: int) -> np.ndarray:
    """d x dims orthonormal: the leading principal axes of the unit vectors (from sums of squares, d x d, bounded by the dimension)."""

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((d + 1, d))
        for batch in batches:
            u = unit(dense(batch.column(0), d))
            out[:d] += u.T @ u
            out[d] += u.sum(axis=0)
        return out

    total = summed(rows.select("e"), squares).reshape(d + 1, d)
    n = max(np.trace(total[:d]), 1)
    return np.linalg.eigh(total[:d] / n - np.outer(total[d], total[d]) / n**2)[1][:, ::-1][:, : min(d, dims)]


def sequenced(vectors: DataFrame, d: int, axes: np.ndarray, eps: float, tile: int) -> DataFrame:
    """vectors (e, many, least) in epsilon grid order, stored: seq (the place in the order) and tile (seq // tile) added, with c, the leading coordinates."""
    dims = axes.shape[1]
    schema = vectors.schema["e"].dataType.simpleString()

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = unit(dense(batch.column(0), d)) @ axes
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims), pa.int32()), pa.array(v.ravel(), kind))
            cells = np.floor(c / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(cells, pa.int32()), lists(c, pa.float64())], names=[*batch.schema.names, "cell", "c"])

    least = vectors.schema["least"].dataType.simpleString()
    placed = vectors.select("e", "many", "least").mapInArrow(coordinates, f"e {schema}, many long, least {least}, cell array<int>, c array<double>")
    ranged = placed.repartitionByRange("cell", "c").sortWithinPartitions("cell", "c")  # c too: one crowded cell spreads over ranges
    order = stored(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "grid_order")
    sizes = order.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = sizes.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row a part
    seq = F.col("at") - F.col("first") + F.col("offset")
    numbered = order.join(F.broadcast(offsets), "part").select(seq.alias("seq"), F.floor(seq / tile).alias("tile"), "e", "many", "least", "c")
    return numbered


def near_tiles(numbered: DataFrame, dims: int, tiles: int, eps: float) -> DataFrame:
    """Pairs of tiles (a <= b) whose boxes lie within eps, found from the whole sequence down. An interval of level l holds FAN ** l tiles."""
    lo, hi = [f"lo{i}" for i in range(dims)], [f"hi{i}" for i in range(dims)]
    edges = [f(F.col("c")[i]).alias(n[i]) for f, n in ((F.min, lo), (F.max, hi)) for i in range(dims)]
    levels = [numbered.groupBy(F.col("tile").alias("t")).agg(*edges).checkpoint()]
    size = tiles
    while size > 1:
        levels.append(levels[-1].groupBy(F.floor(F.col("t") / FAN).alias("t")).agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi]).checkpoint())
        size = -(-size // FAN)
    pairs = levels[-1].select(F.col("t").alias("a"), F.col("t").alias("b"))  # the root with itself
    for level in reversed(levels[:-1]):
        side = lambda s, level=level: level.select(F.floor(F.col("t") / FAN).alias(s), F.col("t").alias(f"{s}_t"), *[F.col(c).alias(f"{s}_{c}") for c in (*lo, *hi)])
        gaps = [F.greatest(F.lit(0.0), F.col(f"b_{x}") - F.col(f"a_{y}"), F.col(f"a_{x}") - F.col(f"b_{y}")) for x, y in zip(lo, hi, strict=True)]
        distance = sum((g * g for g in gaps), F.lit(0.0))
        parts = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("a_t") <= F.col("b_t")) & (distance <= (eps + SLACK) ** 2))
        pairs = parts.select(F.col("a_t").alias("a"), F.col("b_t").alias("b")).checkpoint()
    return pairs


def links(numbered: DataFrame, pairs: DataFrame, d: int, wide: bool, threshold: float) -> DataFrame:
    """seq, n (copies that it links with in a pair of tiles) or seq, other (a link of a spanning forest of the pair's links)."""
    kind = np.float64 if wide else np.float32

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        seq = group.column("seq").to_numpy()
        order = np.argsort(seq)
        e = group.column("e").combine_chunks()
        e = e if isinstance(e, pa.Array) else pa.concat_arrays(e.chunks)
        return pa.table({"t": [key[0].as_py()], "first": [int(seq.min())], "x": [dense(e, d)[order].astype(kind).tobytes()], "m": [group.column("many").to_numpy()[order].astype(np.int64).tobytes()]})

    tiles = stored(numbered.select("tile", "seq", "e", "many").groupBy("tile").applyInArrow(pack, "t long, first long, x binary, m binary"), "tiles")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sides = sorted(group.select(["first", "x", "m"]).to_pylist(), key=lambda r: r["first"])
        x = [unit(np.frombuffer(s["x"], kind).astype(np.float64).reshape(-1, d)) for s in sides]
        m = [np.frombuffer(s["m"], np.int64) for s in sides]
        seq = np.concatenate([s["first"] + np.arange(len(v)) for s, v in zip(sides, x, strict=True)])
        counts, forest, _ = joined_tiles(x[0], x[1] if len(x) > 1 else None, m[0], m[1] if len(x) > 1 else None, threshold)
        some = np.flatnonzero(counts)
        ends = np.array(forest, dtype=np.int64).reshape(-1, 2)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({
            "seq": pa.array(np.concatenate([seq[some], seq[ends[:, 0]]])),
            "n": pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(ends), pa.int64())]),
            "other": pa.concat_arrays([none, pa.array(seq[ends[:, 1]])]),
        })

    sides = pairs.withColumn("t", F.explode(F.array_distinct(F.array("a", "b"))))
    out = sides.join(tiles, "t").groupBy("a", "b").applyInArrow(compare, "seq long, n long, other long")
    with arrow_batches(numbered.sparkSession, 64):
        return stored(out, "tile_links")


def grouped(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, dims: int = 8, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """id, n_links, component_id, kept, a row a vector. threshold lies between 0 and 1."""
    shared_dir(rows.sparkSession)  # checkpoint() needs it set
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("e"))
    ok = usable(F.col("e")) & F.exists("e", lambda c: c != 0)
    d = common_length(given.filter(ok), "e")
    fits = F.coalesce(ok & (F.size("e") == d), F.lit(False))
    alone = given.filter(~fits).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    if not d:
        return alone
    good = stored(given.filter(fits), "vectors")
    vectors = stored(good.groupBy("e").agg(F.count("*").alias("many"), F.min("id").alias("least")), "distinct_vectors")
    eps = float(np.sqrt(2 - 2 * threshold))
    wide = vectors.schema["e"].dataType.elementType.simpleString() != "float"
    tile = max(1, tile_bytes // (4 * d))
    numbered = stored(sequenced(vectors, d, leading_axes(vectors, d, dims), eps, tile), "sequence")
    tiles = -(-numbered.count() // tile)
    pairs = near_tiles(numbered, min(d, dims), tiles, eps)
    found = links(numbered, pairs, d, wide, threshold)
    edges = found.filter("other IS NOT NULL").select(F.col("seq").alias("a"), F.col("other").alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = components(ends, edges)
    slim = numbered.select("seq", "e", "many", "least")
    counts = found.filter("n IS NOT NULL").groupBy("seq").agg(F.sum("n").alias("n"))
    named = slim.drop("e").join(label.select(F.col("node").alias("seq"), "label"), "seq", "left").withColumn("label", F.coalesce("label", "seq"))
    named = named.join(counts, "seq", "left").select("seq", "label", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links")).checkpoint()
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_seq = split_join(named, least, ["label"]).select("seq", "n_links", "component_id")
    by_vector = slim.select("seq", "e").join(by_seq, "seq").drop("seq")
    out = split_join(good, by_vector, ["e"]).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    result = stored(out.unionByName(alone), "vector_links")
    for df in (good, vectors, numbered, found):
        dropped(df)
    return result
