"""Plug-ins for what needs a service or a model: language detection, entities, parts of speech, embeddings, answers.

A plug-in is a function of a pandas Series; it runs in Arrow batches. What an external service returns is landed with
``landed`` before it is used, so that a lost executor doesn't pay for it twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = "array<struct<label:string,start:int,end:int,text:string>>"
KINDS = {"language": "string", "entities": ENTITIES, "tags": "array<string>", "tokens": "array<struct<word:string,tag:string>>", "embedding": "array<double>", "answer": "string"}

#: Characters, or words, that a task turns into Python objects at once, or those of one text.
ROOM = 1 << 20


def parts(sizes: np.ndarray, most: int, room: int = ROOM) -> Iterator[tuple[int, int]]:
    """Where parts of a batch begin and end that hold at most ``most`` texts and ``room`` of their sizes, or one text."""
    at, ends = 0, np.r_[0, np.cumsum(sizes)]
    while at < len(sizes):
        to = max(at + 1, min(at + most, int(np.searchsorted(ends, ends[at] + room, "right")) - 1))
        yield at, to
        at = to


@dataclass(frozen=True)
class Plugin:
    """kind: one of KINDS, which gives the column's type. Calls get at most ``batch`` texts, and about ROOM characters; they are repeated up to ``tries`` times,
    waiting twice as long each time, on errors of the kind ``retry_on``; after that the texts' results are null."""

    kind: str
    run: Callable[[list[str]], list]
    batch: int = 100
    tries: int = 3
    wait: float = 1.0
    retry_on: tuple[type[Exception], ...] = (TimeoutError,)

    def column(self, text: Column) -> Column:
        plugin = self

        @F.pandas_udf(KINDS[self.kind])
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                for at, to in parts(texts.str.len().fillna(0).to_numpy(), plugin.batch):  # a part's results leave before the next one's are made
                    yield pd.Series(plugin.called(["" if t is None else t for t in texts.iloc[at:to]]), dtype=object)

        return apply(text)

    def called(self, texts: list[str]) -> list:
        for turn in range(self.tries):
            try:
                return list(self.run(texts))
            except self.retry_on:
                if turn + 1 < self.tries:
                    time.sleep(self.wait * 2**turn)
        return [None] * len(texts)


def landed(df: DataFrame, path: str) -> DataFrame:
    """df written once and read back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def entities_near(entities: Column, places: Column, kinds: dict[str, tuple[str, ...]], reach: int = 90) -> dict[str, Column]:
    """n_{kind}: entities with one of the kind's labels at most ``reach`` characters from one of the places (character offsets)."""
    near = F.filter(entities, lambda e: F.exists(places, lambda p: (e.start - p <= reach) & (p - e.end <= reach)))
    is_one = lambda labels: lambda e: e.label.isin(list(labels))
    return {f"n_{k}": F.size(F.filter(near, is_one(v))) for k, v in kinds.items()}
