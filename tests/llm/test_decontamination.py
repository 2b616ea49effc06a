import random
import re

from lexalloy.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            for s in range(max(1, len(b) - window + 1) if b else 0):
                p = b[s : s + window]
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def cases():
    r = random.Random(3)
    vocabulary = ["the", "a", "Éa", "x1", "of", *("w%d" % i for i in range(20))]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, "THE of"), (4, None), (5, "..."), (6, text(30)), (7, "the the the")]
    items.append((8, items[0][1].upper()))
    docs = [(i, text(r.randint(0, 60)) + ", " + (r.choice(items)[1] or "") + "\n" + text(9) if i % 2 else text(40)) for i in range(40)] + [(100, None), (101, ""), (102, " the  the-the the! " * 30), (103, items[0][1] * 3), (103, "the of")]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, row int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in dc.judged(d, b, **more).drop("row").collect())


def test_equals_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == sorted(brute(docs, items))


def test_other_paths_give_the_same(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index, full = dc.build_index(d, b), dc.build_index(d, b, max_literals=3)
    patterns = dc.phrases(b, 13)
    found = lambda i, **more: sorted((r["row"], sorted(tuple(h) for h in r["hits"]), r["items"]) for r in dc.matches(i, patterns, **more).collect())
    want = found(index)
    assert any(h for _, h, _ in want) and found(full) == want and found(index, max_broadcast=0) == want
    assert found(full, max_broadcast=0, salt_rows=5) == want  # the commonest words in many salts


def test_a_phrase_of_many_items(spark):
    docs = [(i, "one two three " * (1 + i % 7)) for i in range(30)] + [(99, "one two four")]
    items = [(i, "two three") for i in range(300)] + [(500, "two")]
    assert run(spark, docs, items) == sorted(brute(docs, items))


def test_items_without_an_id_hit_and_are_not_listed(spark):
    assert run(spark, [(1, "a b c"), (2, "b c")], [(None, "b c")]) == [(1, 3, 2, [], True), (2, 2, 2, [], True)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x x gamma"), (2, "alpha " + "x " * 60 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma x")], "item_id long, text string")
    assert sorted({r.doc_id for r in dc.proximity(dc.build_index(d, b), b).collect()}) == [1, 3]


def test_proximity_equals_brute_force(spark):
    """Ties of frequency are broken by the words' hashes, so words of an item differ in frequency here."""
    import random

    r = random.Random(3)
    rare = {w: n for n, w in enumerate(["zeta", "eta", "iota", "kappa", "mu"], 3)}
    docs = []
    for i in range(40):
        words = [r.choice(["a", "b", "c", "d"]) for _ in range(r.randint(5, 120))]
        docs.append((i, words))
    for w, n in rare.items():
        for k in range(n):
            words = docs[(k * 7 + n) % 12][1]
            words.insert(r.randrange(len(words) + 1), w)
    items = [(1, "zeta iota eta a"), (2, "mu kappa"), (3, "kappa"), (4, "unseen words"), (5, None)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(99, None)], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for most in (100_000, 0):
        found = dc.proximity(dc.build_index(frame, tests), tests, rarest=3, span=9, max_broadcast=most)
        got = sorted((x.doc_id, x.item_id, x.position) for x in found.collect())
        count = lambda w: sum(d.count(w) for _, d in docs)
        want = []
        for item, text in items:
            seen = sorted({w for w in (text or "").split() if count(w)}, key=count)[:3]
            for i, d in docs:
                for at, w in enumerate(d):
                    if seen and w == seen[0] and all(o in d[max(at - 9, 0) : at + 10] for o in seen[1:]):
                        want.append((i, item, at))
        assert got == sorted(want) and len(got) > 3
