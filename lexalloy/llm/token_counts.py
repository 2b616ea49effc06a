"""Token counts of whole texts (operator 2): overlap resynchronisation.

A text up to ``chunk_chars`` is encoded in one go. A longer one is encoded in overlapping chunks with offsets.
Two neighbouring chunks are spliced at a common token boundary p of their overlap that is *proven stable*: the
character before p is not white space and the one at p is a space or a line feed. The byte-level pre-tokeniser's
pieces hold white space only in front, so it cuts at such a p whatever stands further left or right, merges never
cross a cut, and no special string holds white space. If an overlap has no such boundary, it is widened (doubled)
until one is found or the text ends. So the sum over the spliced parts is the count of the whole text.

Shorter texts are counted by their units, remembered between texts: a unit is what lies between two such boundaries.

Defined results: a null text counts as empty (0 tokens); a text without white space is encoded whole; repeated rows are counted each; an empty table gives an
empty table; further columns pass through, and the columns added here replace any of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of white space and the run of other characters behind it: cut where a stable boundary is, at each place.
_UNITS = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space, the tokenizers' patterns don't: such texts are encoded without the memo.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MEMO_MAX, _UNIT_MAX = 1_000_000, 200


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """Once a worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: A place at which every encoding of a surrounding part of a text cuts: a space or line feed behind no white space.
_STABLE = re.compile(r"(?<=\S)[ \n]")


def _token_at(encoding, begin: int, place: int) -> int | None:
    """The token that begins at a place of the text, in the encoding of its part from begin on; None if none does."""
    token = encoding.char_to_token(place - begin)
    return token if token is not None and encoding.token_to_chars(token)[0] == place - begin else None


def spliced(tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> Iterator[tuple]:
    """Yields (encoding of a chunk, first token, one behind the last one): spliced together, they are the tokens of the whole text."""
    encoded = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    n, done, begin, end, first, overlap = len(text), 0, 0, min(chunk_chars, len(text)), 0, overlap_chars
    now = encoded(begin, end)
    while end < n:
        after = max(done + 1, end - overlap)  # where the next chunk begins: one character before the first place to splice
        next_end = min(n, max(after + chunk_chars, end + overlap))
        following, middle = encoded(after, next_end), (after + end) // 2
        places = sorted((m.start() for m in _STABLE.finditer(text, after + 1, max(end - 1, after + 1))), key=lambda p: abs(p - middle))
        common = ((p, _token_at(now, begin, p), _token_at(following, after, p)) for p in places)
        found = next((c for c in common if None not in c), None)  # aligned: both chunks have a token that begins there
        if found:
            yield now, first, found[1]
            now, begin, end, overlap, (done, _, first) = following, after, next_end, overlap_chars, found
        else:  # alignment failed: widen the overlap, to the right and to the left
            overlap *= 2
            begin, end, first = done, min(n, end + overlap), 0
            now = encoded(begin, end)
    yield now, first, len(now)


def encode_by_chunks(tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> Iterator[np.ndarray]:
    """Yields the ids of successive spliced parts of text; together they are the ids of the whole text."""
    for encoding, first, last in spliced(tokenizer, text, chunk_chars, overlap_chars):
        yield np.array(encoding.ids[first:last], dtype=np.int64)


class Memo:
    """Counts of the units of a text, remembered between texts. A unit's count doesn't depend on what is around it."""

    def __init__(self, path: str):
        self.tokenizer, self.known = load_tokenizer(path), {}

    def count(self, text: str) -> int:
        if _ODD_SPACE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        units, known = _UNITS.findall(text), self.known
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            new = list({u for u in units if u not in known})
        if len(known) + len(new) > _MEMO_MAX:
            known.clear()
            new = list(set(units))
        counts = {u: len(e.ids) for u, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
        known.update((u, c) for u, c in counts.items() if len(u) <= _UNIT_MAX)
        return sum(known[u] if u in known else counts[u] for u in units)


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo(path)


def count_text(text: str | None, path: str, chunk_chars: int, overlap_chars: int) -> int:
    if not text:
        return 0
    if len(text) <= chunk_chars:
        return _memo(path).count(text)
    return sum(last - first for _, first, last in spliced(load_tokenizer(path), text, chunk_chars, overlap_chars))


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512, chunk_chars: int = 8_192, overlap_chars: int = 256) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens, over_limit. path: a byte-level BPE .json of the tokenizers library, there on each executor."""

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return pd.Series([count_text(t, path, chunk_chars, overlap_chars) for t in texts], dtype="int64")

    counted = docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "n_tokens": n_tokens(F.col(text_col))})
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
