import collections
import random

import numpy as np
from pyspark.sql import functions as F

from lexalloy.llm import near_duplicates as nd


def labelled(text, k=5):
    w = (text or "").lower().split()
    grams = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    seen, out = collections.Counter(), []
    for g in grams:
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def similarity(a, b):
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) if a and b else 0.0


def brute(texts):
    seqs, parent = [labelled(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "").lower().split() and ((texts[i] or "").lower().split() == (texts[j] or "").lower().split() or similarity(seqs[i], seqs[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([60, 120, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 9)):
            copy = base[:]
            for _ in range(r.randint(0, len(base) // 40)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(6)]
    texts += [None, "", " ", "a", "a", "a b c", "a b c", "a b c d", "x " * 300, "x " * 300 + "y", "x " * 200]
    return texts


def test_groups_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, keys string, n int")
    got = {r.doc_id: r.class_id for r in nd.grouped(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_one_first_row_a_class_and_repeats(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    rows = nd.grouped(docs).collect()
    assert len(rows) == 4 and sum(r.first for r in rows) == 2 and {r.class_id for r in rows} == {3, 4}
    assert nd.grouped(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = ["w%d" % i for i in range(150)]
    texts = []
    for i in range(600):
        copy = base[:]
        copy[r.randrange(150)] = "z%d" % i
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.class_id for x in nd.grouped(docs).collect()} == {0}


def edited(words, places, tag):
    out = words[:]
    for p in places:
        out[p] = f"{tag}x{p}"
    return out


def test_a_star_of_copies_that_only_the_original_links(spark):
    r = random.Random(3)
    base = ["w%d" % i for i in range(200)]
    texts = [" ".join(edited(base, r.sample(range(5, 195, 10), 4), i)) for i in range(700)]
    texts.insert(431, " ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"cheap": 0}, {"block": 50}):
        assert {x.class_id for x in nd.grouped(docs, **options).collect()} == {0}, options


def test_a_bucket_that_one_class_dominates(spark):
    r = random.Random(4)
    base = ["w%d" % i for i in range(200)]
    texts = [edited(base, [r.randrange(200)], i) for i in range(400)]
    for i in range(120):  # pairs near to each other, not to the base nor to other pairs
        one = edited(base, r.sample(range(5, 195, 10), 8), "m%d" % i)
        texts += [one, edited(one, [r.randrange(200)], "n%d" % i)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    hashed = docs.select("doc_id", F.transform(F.split("text", " "), lambda w: F.hash(w)).alias("w")).orderBy("doc_id").collect()
    keys = [x[0] for x in nd.order_min_hash([np.array(h.w, np.int32).view(np.uint32) for h in hashed], 5, 1, 3)]
    most = collections.Counter(keys).most_common(1)[0][0]
    pairs = [i for i in range(400, 640, 2) if keys[i] == keys[i + 1] == most]
    assert len(pairs) > 5
    for options in ({}, {"cheap": 0}, {"block": 20}):
        got = {x.doc_id: x.class_id for x in nd.grouped(docs, sketches=1, **options).collect()}
        assert all(got[i] == got[i + 1] == i for i in pairs), options


def test_alignment_is_order_sensitive_and_exact():
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.permutation(60)[: r.integers(1, 60)].astype(np.uint64)
        b = np.delete(a, r.integers(0, len(a), 3)) if r.random() < 0.7 else r.permutation(a)
        want = similarity(a.tolist(), b.tolist())
        got = nd.alignment(a, b, 0.8)
        assert got == want if want >= 0.8 else got < 0.8


def test_components_of_a_chain(spark):
    nd.shared_dir(spark)
    nodes = spark.range(50).select((49 - F.col("id")).alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(i + 1, i) for i in range(30, 49)], "a long, b long")
    assert {(r.node, r.label) for r in nd.components(nodes, edges).collect()} == {(i, 0 if i < 30 else 30) for i in range(50)}


def test_recall_of_all_pairs_on_the_given_tables(spark):
    """Every pair of the small documents table with an ordered or a plain Jaccard coefficient of 0.8 or more is in one class."""
    import itertools
    from pathlib import Path

    import pytest

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("the driver's tables aren't here")
    docs = spark.read.parquet(str(path))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    seqs = {i: labelled(t) for i, t in texts.items() if (t or "").strip()}
    holders = collections.defaultdict(list)
    for i, s in seqs.items():
        for g in s:
            holders[g].append(i)
    common = collections.Counter()
    for ids in holders.values():
        common.update(itertools.combinations(sorted(set(ids)), 2))
    pairs = [p for p, n in common.items() if n >= 0.8 * (len(seqs[p[0]]) + len(seqs[p[1]]) - n)]
    classes = {r.doc_id: r.class_id for r in nd.grouped(docs).collect()}
    caught = sum(classes[a] == classes[b] for a, b in pairs)
    print(f"{len(pairs)} pairs, {caught} caught")
    assert len(pairs) > 20 and caught >= 0.99 * len(pairs)


def test_kept_columns_may_have_working_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 1.5, None), (2, text, "b", 2.5, "k"), (3, "x " * 50_000, "c", 0.0, "z")], "doc_id long, text string, n string, h double, keys string")
    rows = {r.doc_id: r for r in nd.grouped(docs, keep=("n", "h", "keys")).collect()}
    assert [(rows[i].n, rows[i].h, rows[i]["keys"], rows[i].class_id) for i in (1, 2, 3)] == [("a", 1.5, None, 1), ("b", 2.5, "k", 1), ("c", 0.0, "z", 3)]


def test_joins_of_hot_keys_equal_plain_ones(spark):
    from lexalloy.llm.common import split_join

    left = spark.range(6000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = sorted(map(tuple, split_join(left, right, ["k"], share=10).collect()))
    assert got == sorted(map(tuple, left.join(right, ["k"]).collect())) and len(got) > 3000
