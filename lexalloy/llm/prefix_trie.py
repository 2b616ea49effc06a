"""The prefix trie of conversations, measured by the Euler-tour technique.

Each conversation is rebuilt (a head that it shares, then its own turns), each distinct sequence of its first turns is a
node. A node's key is its depth and a sum, over its turns, of 128-bit hashes of (place, role, text): sums run on in pieces of
32 bits, so prefixes of one conversation that holds most rows can be summed in parallel. The tree becomes a list of
arcs (into a node, out of it), the list is ranked by contraction with joins, and what a subtree holds is the
difference of two prefix sums. No group is gathered anywhere: orders and places come from range sorts, whose parts hand
on a count or a row; turns stay where they are.

Defined results: rows without a conv_id are no conversation's; null role and text are empty; turns with the same number
are ordered by role, then text (so order doesn't depend on the run), repeated rows are repeated turns; conversations that the rebuilding
leaves without turns are members of the root only; an empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, shared_dir, split_join, stored

PIECES = ("k0", "k1", "k2", "k3")

#: Turns of a conversation that are summed together; sums go over the turns of a block, and over the blocks.
RUN = 512


def ordered(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """df in a total order, stored: part, the number of its range, and at, its place there (rising from 0, not gapless)."""
    ranged = df.repartitionByRange(*[F.asc_nulls_first(c) for c in by]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in by])
    return stored(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)


def places(rows: DataFrame, key: str) -> DataFrame:
    """rows (from ``ordered``, key first) with place: the row's number in its key, from 1. Counts of earlier parts are added,
    so a key may span any number of parts."""
    here = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = here.withColumn("before", F.sum("n").over(before)).filter("before > 0").select(key, "part", "before")  # a row a part at most
    inside = Window.partitionBy(key, "part").orderBy("at")
    numbered = rows.withColumn("place", F.row_number().over(inside).cast("long"))
    return numbered.join(F.broadcast(carried), [key, "part"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("before")


def followed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows (from ``ordered``) with next, the struct of columns of the row after it in the total order (null for the last)."""
    value = F.struct(*columns)
    first = rows.groupBy("part").agg(F.min_by(value, "at").alias("first"))  # a row a part
    onward = first.select("part", F.lead("first").over(Window.orderBy("part")).alias("onward"))
    inside = Window.partitionBy("part").orderBy("at")
    return rows.withColumn("next", F.lead(value).over(inside)).join(F.broadcast(onward), "part", "left").withColumn("next", F.coalesce("next", "onward")).drop("onward")


def rebuilt(rows: DataFrame, head: Column, base: Column, longest: int) -> DataFrame:
    """conv_id, place (from 1), content, bytes: the first ``head`` (``longest`` at most) turns of conversation ``base``, then the conversation's own
    turns after its first ``head``. Also, with a null place, one row for each conversation. rows: conv_id, turn, role, text."""
    turns = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    placed = places(ordered(turns, ("conv_id", "turn", "role", "text"), "turns"), "conv_id")
    content = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    slim = stored(placed.select("conv_id", "place", content.alias("content"), F.octet_length("text").cast("long").alias("bytes")), "slim")
    convs = slim.filter("place = 1").select("conv_id", head.alias("head"), base.alias("base"))
    heads = slim.filter(F.col("place") <= longest).join(convs.select(F.col("conv_id").alias("c"), "base", "head"), (F.col("conv_id") == F.col("base")) & (F.col("place") <= F.col("head"))).select(F.col("c").alias("conv_id"), "place", "content", "bytes")
    heads = heads.checkpoint()
    lengths = heads.groupBy("conv_id").agg(F.count("*").alias("shared"))
    with_length = convs.join(lengths, "conv_id", "left").select("conv_id", "head", F.coalesce("shared", F.lit(0)).alias("shared"))
    own = split_join(slim, with_length, ["conv_id"]).filter("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("shared")).alias("place"), "content", "bytes")
    none = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("bytes"))
    return heads.unionByName(own).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k0..k3 (the key's sums up to this turn), p0..p3 (this turn's part of them), bytes. turns as of ``rebuilt``."""
    hashed = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("content")).cast("binary"))
    pieces = {f"p{i}": F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    tagged = stored(turns.filter("place IS NOT NULL").withColumns(pieces).withColumn("run", F.floor((F.col("place") - 1) / RUN)), "tagged")
    long_ones = tagged.filter("run > 0").select("conv_id").distinct()
    runs = tagged.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "run").agg(*[F.sum(f"p{i}").alias(f"b{i}") for i in range(4)])
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("conv_id", "run", *[F.sum(f"b{i}").over(before).alias(f"b{i}") for i in range(4)])
    upto = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = tagged.withColumns({k: F.sum(f"p{i}").over(upto) for i, k in enumerate(PIECES)}).join(carried, ["conv_id", "run"], "left")
    return summed.select("conv_id", F.col("place").alias("depth"), *[(F.col(k) + F.coalesce(f"b{i}", F.lit(0))).alias(k) for i, k in enumerate(PIECES)], *[f"p{i}" for i in range(4)], "bytes")


def list_ranked(arcs: DataFrame, sums: Sequence[str], alone: int = 50_000) -> DataFrame:
    """Inclusive prefix sums over linked lists. arcs: id and next (structs of one type; next is null at an end) and the columns
    ``sums``, longs. Returns id and the sums over all elements from the list's start up to id.

    Each round takes out every element whose coin shows heads and whose predecessor's shows tails (no two neighbours), and adds its
    sums to what comes behind it: a quarter of what is left, with a join of half of it. What remains of ``alone`` elements is walked
    in one task; the elements taken out get their sums back from their predecessors, the last round first. Work and
    shuffle are in proportion to the list: rounds shrink geometrically. Each round is stored, so lost executors cost a round at most."""
    # w: the sums of the elements from this one up to (not including) next
    now = arcs.select("id", "next", *sums)
    taken: list[DataFrame] = []
    owned: list[DataFrame] = []
    left = now.count()
    while left > alone:
        coin = lambda c, r=len(taken): F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 1
        tails = now.filter(~coin("id"))
        asks = tails.filter(F.coalesce(coin("next"), F.lit(False)))
        heads = now.filter(coin("id")).select(F.col("id").alias("h_id"), F.col("next").alias("h_next"), *[F.col(c).alias(f"h_{c}") for c in sums])
        both = stored(asks.join(heads, F.col("next") == F.col("h_id"), "full_outer"), "contracted")
        joined = both.filter("id IS NOT NULL").select("id", F.col("h_next").alias("next"), *[(F.col(c) + F.coalesce(f"h_{c}", F.lit(0))).alias(c) for c in sums])
        kept = both.filter("id IS NULL").select(F.col("h_id").alias("id"), F.col("h_next").alias("next"), *[F.col(f"h_{c}").alias(c) for c in sums])
        # an element taken out comes behind its predecessor and what that one then stood for
        taken.append(both.filter("id IS NOT NULL AND h_id IS NOT NULL").select(F.col("h_id").alias("id"), F.col("id").alias("from"), *[F.col(c).alias(f"w_{c}") for c in sums]))
        now = stored(joined.unionByName(kept).unionByName(tails.filter(~F.coalesce(coin("next"), F.lit(False)))), "list")
        owned += [both, now]
        left = now.count()
    ranked = walked(now, sums)  # sums before each element
    for out in reversed(taken):
        behind = ranked.join(out, F.col("from") == ranked["id"]).select(out["id"], *[(F.col(c) + F.col(f"w_{c}")).alias(c) for c in sums])
        ranked = stored(ranked.unionByName(behind), "ranked")
        owned.append(ranked)
    result = ranked.alias("r").join(arcs.alias("a"), F.col("r.id") == F.col("a.id")).select("r.id", *[(F.col(f"r.{c}") + F.col(f"a.{c}")).alias(c) for c in sums])
    result = stored(result, "prefix_sums")
    for df in owned:
        dropped(df)
    return result


def walked(elements: DataFrame, sums: Sequence[str]) -> DataFrame:
    """id and the sums before it, by walking lists of a bounded number of elements in one task."""
    kind = elements.schema["id"].dataType.simpleString()
    fields = [f.name for f in elements.schema["id"].dataType.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onward: dict[tuple, tuple] = {}
        pointed = set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "next", *sums)]
            for i, n, *w in zip(*columns, strict=True):
                key = tuple(i[f] for f in fields)
                to = None if n is None else tuple(n[f] for f in fields)
                pointed.add(to)
                onward[key] = (to, w)
        ids, totals = [], [[] for _ in sums]
        for at in [k for k in onward if k not in pointed]:
            total = [0] * len(sums)
            while at is not None:
                ids.append(dict(zip(fields, at, strict=True)))
                for t, v in zip(totals, total, strict=True):
                    t.append(v)
                at, w = onward[at]
                total = [a + b for a, b in zip(total, w, strict=True)]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), *[pa.array(t, pa.int64()) for t in totals]], names=["id", *sums])

    return elements.coalesce(1).mapInArrow(walk, f"id {kind}, " + ", ".join(f"{c} long" for c in sums))


def joined_hashes(rows: DataFrame, key: str, value: str, longest: int = 1 << 16) -> DataFrame:
    """key, sha: SHA-256 of the key's values (longs), ascending, comma-joined. Parts of a range sort make pieces of text, of which a key's
    are hashed one after the other: a task never holds more than one piece of a key."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key_now, size = None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key_now], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["key", "first", "piece"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key_now or size >= longest):
                    yield out()
                    held, size = [], 0
                key_now = k
                held.append(v)
                size += 8
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, digest = None, None
        for batch in batches:
            ids, hashes = [], []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key_now or digest is None:
                    if digest is not None:
                        ids.append(key_now)
                        hashes.append(digest.hexdigest())
                    key_now, digest = k, hashlib.sha256(piece.encode())
                else:
                    digest.update(f",{piece}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["key", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key_now], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "sha"])

    cut = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange("key", "value").sortWithinPartitions("key", "value").mapInArrow(pieces, "key long, first long, piece string")
    return cut.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(digests, "key long, sha string")


def trie(rows: DataFrame, head: Column, base: Column, longest: int = 8, alone: int = 50_000) -> DataFrame:
    """A row a node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and the places of its arcs in the tour (enter, exit; from 1). head, base, longest: see ``rebuilt``."""
    spark = rows.sparkSession
    shared_dir(spark)  # checkpoint() needs it set
    turns = stored(rebuilt(rows, head, base, longest), "rebuilt")
    convs = turns.filter("place IS NULL").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not convs["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, enter long, exit long")
    members = stored(prefixes(turns), "prefixes")
    key = ["depth", *PIECES]
    nodes = members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(4)], F.first("bytes").alias("bytes"))
    nodes = stored(nodes, "nodes")

    # the parent: a turn less, its hash taken off; the root has no row here
    up = nodes.filter("depth > 1").select((F.col("depth") - 1).alias("depth"), *[(F.col(k) - F.col(f"p{i}")).alias(k) for i, k in enumerate(PIECES)], F.col("conv_id").alias("child"), "n_convs", "bytes")
    parents = nodes.select(*key, F.col("conv_id").alias("parent_conv_id"))
    root = F.lit(convs["least"])
    child = split_join(stored(up, "up"), parents, key).select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id", "n_convs", "bytes")
    first = nodes.filter("depth = 1").select("conv_id", "depth", root.alias("parent_conv_id"), "n_convs", "bytes")
    children = ordered(child.unionByName(first), ("depth", "parent_conv_id", "conv_id"), "children")
    top = spark.range(1).select(root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(convs["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    below = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    with_next = followed(children, ("parent_conv_id", "depth", "conv_id")).select("conv_id", "depth", "parent_conv_id", "n_convs", "bytes", F.when((F.col("next.parent_conv_id") == F.col("parent_conv_id")) & (F.col("next.depth") == F.col("depth")), F.col("next.conv_id")).alias("sibling"))
    every = with_next.unionByName(top.withColumn("sibling", F.lit(None).cast("long")))
    tree = stored(every.join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")

    # the tour: into a node, through its children, out of it
    arc = lambda conv, depth, out: F.struct(conv.alias("conv_id"), depth.alias("depth"), F.lit(out).alias("out"))
    c, d = F.col("conv_id"), F.col("depth")
    into = F.when(F.col("first_child").isNotNull(), arc(F.col("first_child"), d + 1, 0)).otherwise(arc(c, d, 1))
    onward = F.when(F.col("sibling").isNotNull(), arc(F.col("sibling"), d, 0)).when(d > 0, arc(F.col("parent_conv_id"), d - 1, 1))
    zero = F.lit(0).cast("long")
    enter = tree.select(arc(c, d, 0).alias("id"), into.alias("next"), F.lit(1).cast("long").alias("steps"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    leave = tree.select(arc(c, d, 1).alias("id"), onward.alias("next"), F.lit(1).cast("long").alias("steps"), zero.alias("leaves"), zero.alias("saved"))
    arcs = stored(enter.unionByName(leave), "arcs")
    ranked = list_ranked(arcs, ("steps", "leaves", "saved"), alone)

    side = lambda column, out: F.sum(F.when(F.col("id.out") == out, F.col(column)))
    spans = ranked.groupBy("id.conv_id", "id.depth").agg(side("steps", 0).alias("enter"), side("steps", 1).alias("exit"), *[(side(s, 1) - side(s, 0)).alias(s) for s in ("leaves", "saved")])

    # turns end at the deepest node of each conversation
    last = members.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("end")).select("conv_id", "end.*")
    node_ids = nodes.select(*key, F.col("conv_id").alias("node"))
    ended = split_join(stored(last, "ends"), node_ids, key).select("node", "depth", "conv_id")
    turnless = turns.filter("place IS NULL").select("conv_id").join(members.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(root.alias("node"), zero.alias("depth"), "conv_id")
    # a node by one number: nodes of a conversation's path get its place among those that something ends at
    ends = ended.unionByName(turnless)
    targets = ordered(ends.select("node", "depth").distinct(), ("node", "depth"), "targets").select("node", "depth", F.col("at").alias("target"))
    hashes = joined_hashes(split_join(stored(ends, "all_ends"), targets, ["node", "depth"]), "target", "conv_id")
    shas = targets.join(hashes, F.col("target") == F.col("key")).select(F.col("node").alias("conv_id"), "depth", "sha")
    nothing = hashlib.sha256(b"").hexdigest()
    out = tree.join(spans, ["conv_id", "depth"]).join(shas, ["conv_id", "depth"], "left")
    # inside a node's tour: its own leaf counts at its enter arc
    leaves = F.col("leaves") + (F.col("n_children") == 0).cast("long")
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"), "enter", "exit")
