import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexalloy.llm import prefix_trie
from lexalloy.llm.common import fold

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """By the contract's words: every prefix of every rebuilt conversation, its members, its subtree."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in convs.items()}
    again = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members, ends = {}, {}
    for c, ts in again.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) if below else 1
        saved[k] = sum(saved[b] for b in below) + (len(members[k]) - 1) * len(k[-1][1].encode() if k else b"")
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in members.items())


def found(rows_df, **more):
    c = F.col("conv_id")
    return prefix_trie.trie(rows_df, head=fold("conv_id", 9), base=c - c % 5, **more)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("alone", [40, 50_000])
def test_equals_brute_force(spark, alone, monkeypatch):
    """With contraction down to a handful of arcs, and with runs of a few turns."""
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rng = random.Random(alone)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "long " * 5])) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(3, None, None, "x"), (3, None, None, "x"), (3, 2, "user", "z"), (None, 1, "user", "a"), (77, None, None, None)]  # null and tied turns, no conversation
    rows += [(1000 + i, 0, "user", "same") for i in range(30)] + [(5, 20 + t, "user", f"turn {t % 3}") for t in range(60)]
    got = found(made(spark, rows).withColumn("depth", F.lit("clash")).repartition(5), alone=alone).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)
    # the tour passes each node's arcs in order, and all of them
    spans = sorted((r["enter"], r["exit"]) for r in got)
    assert sorted(p for s in spans for p in s) == list(range(1, 2 * len(got) + 1)) and all(a < b for a, b in spans)


def test_empty_and_turnless(spark):
    assert found(made(spark, [])).count() == 0
    assert found(made(spark, [(None, 0, "user", "a")])).count() == 0
    only = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # its one turn goes, and there is no base
    got = found(made(spark, [(only, 0, "user", "gone")])).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute([(only, 0, "user", "gone")])
    assert len(got) == 1 and got[0]["n_leaves"] == 1


def test_list_ranking(spark):
    """Two lists of random order, ranked by rounds of contraction."""
    order = random.Random(1).sample(range(500), 500)
    lists = [order[:180], order[180:]]
    rows = [((v,), (xs[i + 1],) if i + 1 < len(xs) else None, 1, v) for xs in lists for i, v in enumerate(xs)]
    arcs = spark.createDataFrame(rows, "id struct<v: long>, next struct<v: long>, one long, value long")
    got = {r["id"]["v"]: (r["one"], r["value"]) for r in prefix_trie.list_ranked(arcs, ("one", "value"), alone=25).collect()}
    for xs in lists:
        assert [got[v] for v in xs] == [(i + 1, sum(xs[: i + 1])) for i in range(len(xs))]


def test_hashes_of_long_lists(spark):
    df = spark.range(5000).select((F.col("id") % 3 * F.lit(0) + F.when(F.col("id") < 10, 1).otherwise(2)).cast("long").alias("k"), (F.col("id") * 7 - 900).alias("v"))
    got = {r["key"]: r["sha"] for r in prefix_trie.joined_hashes(df, "k", "v", longest=64).collect()}
    for k, ids in ((1, range(10)), (2, range(10, 5000))):
        assert got[k] == hashlib.sha256(",".join(str(i * 7 - 900) for i in ids).encode()).hexdigest()
