import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexalloy.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(pieces, texts, window=2048):
    """texts: list of (doc_id, text), ids distinct."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(texts)
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(by_sequence)


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "a b  c"), (4, "x\x1cy É é ́z <|endoftext|> q"), (5, "lorem ipsum " * 4000), (6, "a b  c"), (7, "漢字 " * 50)]
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in texts], "doc_id long, text string, ids string, n int")
    padding, _ = check_pieces(packing.packed(docs, PATH, shard_units=3).collect(), texts)
    assert padding == 0


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    pieces = packing.packed(spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")] * 2, "doc_id long, text string"), PATH).collect()
    assert sum(p.length for p in pieces) == 3 * 4 + 2 * 2


def test_copies_meet_in_a_window(spark):
    words = np.random.default_rng(0)
    vocabulary = ["".join(words.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    texts = [(i, " ".join(words.choice(vocabulary, 40))) for i in range(300)]
    texts += [(1000 + i, t + " extra") for i, t in texts[:50]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pieces = packing.packed(docs, PATH, window=256).collect()
    padding, _ = check_pieces(pieces, texts, 256)
    assert padding == 0
    where = {}
    for p in pieces:
        where.setdefault(p.doc_id, set()).add(p.sequence_id)
    assert sum(bool(where[i] & where[1000 + i]) for i in range(50)) >= 35


def test_pieces_equal_the_tokenizer():
    import random

    import pyarrow as pa

    r = random.Random(2)
    parts = ["a", "The", "DON'T", "'s", "'S", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "12", "²", "é", "é", "İ", "ſ", "ß", "Ж", "“q”", "—", "€", "漢", "<|endoftext|>", "<|", "...", "!!", "_", "x1y", "\x00", "Ǆ", "ª", "'"]
    texts = ["".join(r.choice(parts) + (" " if r.random() < 0.3 else "") for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, ""]
    tokenizer, pieces = Tokenizer.from_file(PATH), packing.PieceIds(PATH)
    for at in range(0, len(texts), 500):
        ids, lengths = pieces.encode_many(pa.array(texts[at : at + 500], pa.string()))
        ends = np.cumsum(lengths)
        for t, a, b in zip(texts[at : at + 500], (ends - lengths).tolist(), ends.tolist(), strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_frequencies_are_exact_and_bounded(spark):
    texts = [f"common w{i % 7} only{i}" for i in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = packing.stored(packing.tokenised(docs, PATH, 1), "test")
    counts = {}
    for t in texts:
        for w in {h for h in packing.word_hashes(packing._pieces(PATH).encode(t), packing.word_ends(PATH, 1))[0].tolist()}:
            counts[w] = counts.get(w, 0) + 1
    word, df = packing.frequent_words(tokens, 1 << 18)
    assert dict(zip(word.tolist(), df.tolist(), strict=True)) == {w: n for w, n in counts.items() if n >= 3}
    word, df = packing.frequent_words(tokens, 4)
    assert len(word) <= 4 and dict(zip(word.tolist(), df.tolist(), strict=True)).items() <= counts.items()


def test_shard_ranks_as_plain_bm25():
    r = np.random.default_rng(1)
    ends = np.ones(50, bool)
    lengths = r.integers(5, 40, 30)
    ids = r.zipf(1.4, lengths.sum()).clip(1, 49).astype("<u2")
    index = packing.Shard(ids, lengths, ends, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 30, 20.0)
    units = np.split(ids, np.cumsum(lengths)[:-1])
    df = {t: sum(t in u for u in units) for t in range(50)}
    for seed in range(30):
        asked = [t for t in set(units[seed].tolist()) if 1 < df[t] <= 15]
        scores = {}
        for i, u in enumerate(units):
            if i != seed:
                for t in asked:
                    tf = int((u == t).sum())
                    if tf:
                        idf = np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5))
                        scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / 20))
        unused = np.ones(30, bool)
        unused[seed] = False
        got = list(index.neighbours(seed, unused))
        assert sorted(got) == sorted(scores) and np.allclose([scores[i] for i in got], sorted(scores.values(), reverse=True))


def test_tails_are_packed_again(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 90)) for i in range(3000)], "doc_id long, text string")
    pieces = packing.packed(docs, PATH, window=128, shard_units=10).collect()
    padding, sequences = check_pieces(pieces, [(i, f"w{i} " * (i % 90)) for i in range(3000)], 128)
    full = sum(p.length for p in pieces) // 128
    assert padding == 0 and sequences <= full + 7
