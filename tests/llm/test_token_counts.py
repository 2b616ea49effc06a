import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexalloy.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(seed=0, n=120):
    r = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "'s", "n't", "1234", "é", "é", "漢字", "🎈", "<|endoftext|>", "<|", "Ab", "...", "\r\n", "-", "zz" * 9]
    return ["".join(r.choice(parts) + (" " if r.random() < 0.4 else "") for _ in range(r.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("chunk,overlap", [(8, 2), (20, 5), (64, 16), (300, 40)])
def test_splices_equal_the_library(library, chunk, overlap):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = [i for part in tc.encode_by_chunks(library, text, chunk, overlap) for i in part.tolist()]
        assert got == want, repr(text)


def test_overlaps_widen_where_no_boundary_is_stable(library):
    for text in ("x" * 5000, "   " * 900, "漢" * 700, "a" + "\n" * 2000 + "b", "<|endoftext|>" * 120):
        got = [i for part in tc.encode_by_chunks(library, text, 50, 8) for i in part.tolist()]
        assert got == library.encode(text, add_special_tokens=False).ids


def test_chunks_are_really_used(library):
    text = "lorem ipsum dolor " * 400
    parts = list(tc.encode_by_chunks(library, text, 512, 64))
    assert len(parts) > 10 and sum(map(len, parts)) == len(library.encode(text, add_special_tokens=False).ids)


def test_every_row_is_counted(spark, library):
    texts = [None, "", "a", "a", " ", "long words and more, 12 of them. " * 900, "x" * 20_000, "<|endoftext|> z", *odd_texts(3, 40)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "b c", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    for options in ({}, {"chunk_chars": 40, "overlap_chars": 8}):
        found = tc.with_token_counts(docs, PATH, **options).collect()
        assert len(found) == len(rows)
        for r in found:
            want = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 512)
    assert tc.with_token_counts(docs.limit(0), PATH).count() == 0
