import random
from difflib import SequenceMatcher

import numpy as np

from lexalloy.operators import title_index as ti


def sequential(batches, threshold=0.9):
    """The rule as it is said: each title against all kept ones, in order."""
    kept, out = [], {}
    for o, title in (x for b in batches for x in sorted(b)):
        t = " ".join((title or "").lower().split())
        hit = next((k for k, s in kept if t and SequenceMatcher(None, t, s).ratio() >= threshold), None)
        out[o] = hit
        if hit is None and t:
            kept.append((o, t))
    return out


def headlines(seed, n):
    """Random headlines, each with near copies of several kinds; some are chains of small changes."""
    r = random.Random(seed)
    words = ["brand", "opens", "store", "paris", "new", "shoe", "market", "profit", "climate", "report", "chief", "says", "plan", "growth", "the", "a", "of"]
    out = []
    while len(out) < n:
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
        out.append(t)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t) + 1)
            t = r.choice([t[:i] + r.choice("xyz ") + t[i:], t[:i] + t[i + 2 :], t.upper(), t + " " + r.choice(words), t])
            out.append(t)
    return out[:n]


def test_three_batches_equal_the_sequential_rule(spark, tmp_path):
    titles = headlines(5, 330) + ["", None, "   ", "ab", "ab", "abc", "a" * 250, "a" * 249 + "b"]
    random.Random(2).shuffle(titles)
    rows = list(enumerate(titles))
    batches = [rows[:120], rows[120:130], rows[130:]]
    index, got = ti.TitleIndex(spark, str(tmp_path / "index")), {}
    for b in batches:
        got |= {r.o: r.duplicate_of for r in index.add(spark.createDataFrame(random.Random(1).sample(b, len(b)), "o long, title string"), "o").collect()}
    want = sequential(batches)
    assert {o: v is None for o, v in got.items()} == {o: v is None for o, v in want.items()}
    assert got == want
    assert index.index().select("o").distinct().count() == sum(want[o] is None and bool((t or "").split()) for o, t in rows)
    again = index.add(spark.createDataFrame(batches[1], "o long, title string"), "o")
    assert again.filter("kept").count() == sum(not (t or "").split() for _, t in batches[1])  # nothing enters twice


def test_segments_cover_a_title_and_candidates_are_few(spark):
    titles = headlines(8, 300)
    frame = spark.createDataFrame(list(enumerate(titles)), "o long, t string")
    cut = ti.segments(frame, 0.9).orderBy("o", "at").collect()
    for o, t in enumerate(titles):
        own = [s for s in cut if s.o == o]
        assert "".join(s.seg for s in own) == t and len(own) == min(int(2 * len(t) * 0.1 / 0.9 + 1e-9) + 1, len(t))
    assert ti.met(ti.probes(frame.limit(0), 0.9), ti.segments(frame, 0.9), 0.9).count() == 0


def test_thresholds(spark):
    titles = list(dict.fromkeys(headlines(9, 120)))
    frame = spark.createDataFrame(list(enumerate(titles)), "o long, t string")
    for threshold in (0.7, 0.95, 1.0):
        got = {(r.later, r.earlier) for r in ti.met(ti.probes(frame, threshold), ti.segments(frame, threshold), threshold, earlier=True).collect()}
        assert got == {(i, j) for i in range(len(titles)) for j in range(i) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= threshold}


def test_blocks_find_the_pairs_of_all_pairs(spark):
    titles = list(dict.fromkeys([*headlines(9, 150), "x" * 300, "x" * 299 + "y", "ab", "abc", "é" * 40, "é" * 39]))
    frame = spark.createDataFrame(list(enumerate(titles)), "o long, t string")
    for threshold in (0.7, 0.9, 1.0):
        got = sorted((r.later, r.earlier) for r in ti.compared(frame, frame, threshold, earlier=True).collect())
        assert got == sorted((i, j) for i in range(len(titles)) for j in range(i) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= threshold)


def test_titles_of_the_same_syllables_leave_few_candidates():
    """Short segments of such titles are everywhere; letters and triples tell them apart."""
    r = random.Random(4)
    syllables = ["".join(r.choices("aeiourstnlh ", k=r.randint(2, 5))) for _ in range(60)]
    titles = sorted(("".join(r.choices(syllables, k=45))[:80] for _ in range(2_000)), key=len)
    titles.insert(1_000, titles[7][:40] + titles[7][41:] + "x")
    found = [(i, j) for a, b in ti.candidates(ti.signatures(titles), ti.signatures(titles), 0.9) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j]
    assert {(7, 1_000), (1_000, 7)} <= set(found)
    assert len(found) < 2_000 * 2_000 / 100


def test_titles_of_the_same_words_in_another_order_are_no_candidates():
    """Letters and triples of such titles agree; their order doesn't."""
    r = random.Random(7)
    words = [c * 8 for c in "abcdefgh"]
    titles = list(dict.fromkeys(" ".join(r.sample(words, 8)) for _ in range(300)))
    titles += ["".join(titles[0]) + "x", titles[1][1:]]
    titles.sort(key=len)
    found = {(i, j) for a, b in ti.candidates(ti.signatures(titles), ti.signatures(titles), 0.9) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, t in enumerate(titles) for j, s in enumerate(titles) if SequenceMatcher(None, t, s).ratio() >= 0.9}
    assert want <= found and len(found) < 2 * len(want)


def test_longest_common_subsequences():
    r = random.Random(3)
    titles = sorted(("".join(r.choices("abc é", k=r.randint(0, 150))) for _ in range(120)), key=len)
    spelt = ti.signatures(titles)[3]
    i, j = (np.array(r.choices(range(120), k=400)) for _ in range(2))

    def walked(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b, 1):
                row.append(last[k - 1] + 1 if x == y else max(last[k], row[-1]))
        return row[-1]

    assert ti.longest_common(spelt[i], spelt[j]).tolist() == [walked(titles[x], titles[y]) for x, y in zip(i, j, strict=True)]


def test_own_titles_meet_once_over_many_blocks(spark, monkeypatch):
    titles = list(dict.fromkeys(headlines(12, 900)))
    frame = spark.createDataFrame(list(enumerate(titles)), "o long, t string")
    made = []
    blocks = ti.blocks
    monkeypatch.setattr(ti, "blocks", lambda x: made.append(blocks(x)) or made[-1])
    got = sorted((r.later, r.earlier) for r in ti.compared(frame, frame, 0.9, earlier=True).collect())
    assert len(made) == 1 and made[0].count() > 2
    assert got == sorted((i, j) for i in range(len(titles)) for j in range(i) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.9)
