"""Blocks of features from entities and parts of speech, by the library's own tagger or any plug-in. Names, labels and brands are arguments."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.plugins import parts


def contained(text: Column, names: Sequence[str]) -> Column:
    """Names that stand anywhere in the text, inside words too, whatever their case."""
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(n)))


def folded(text: str) -> str:
    """Lower case, one code point for each, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def near_names(text: Column, names: Column, entities: Column, reach: int = 90) -> Column:
    """The entities, each with ``near``: those of the names that stand near it, in the names' order. Near: from the end of a mention to
    the entity's start, or from the entity's end to the start of a mention, there are at most ``reach`` characters, either way round.

    Mentions of a name follow each other in the text, so each entity asks by two binary searches whether one lies in its reach: the work is that
    of entities and mentions, not of their pairs. Null texts, names and entities count as empty."""

    def of(text: str, names: Sequence[str], starts: np.ndarray, ends: np.ndarray) -> list[list[str]]:
        low, out = folded(text), [[] for _ in range(len(starts))]
        for name in names:
            begins = np.array([m.start() for m in re.finditer(re.escape(folded(name)), low)] if name else [], np.int64)
            holds = lambda places, at: np.searchsorted(places, at - reach, "left") < np.searchsorted(places, at + reach, "right")
            for i in np.flatnonzero(holds(begins + len(name), starts) | holds(begins, ends)):
                out[i].append(name)
        return out

    @F.pandas_udf("array<array<string>>")
    def run(texts: pd.Series, names: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([of(t, n, np.asarray(a, np.int64), np.asarray(b, np.int64)) for t, n, a, b in zip(texts, names, starts, ends, strict=True)])

    given = F.coalesce(entities, F.array().cast("array<struct<label:string,start:int,end:int,text:string>>"))
    asks = (F.size(names) > 0) & (F.size(given) > 0)  # other texts needn't travel
    near = run(F.when(asks, F.coalesce(text, F.lit(""))).otherwise(F.lit("")), F.coalesce(names, F.array().cast("array<string>")), given["start"], given["end"])
    return F.zip_with(given, near, lambda e, n: F.struct(e.label.alias("label"), e.start.alias("start"), e.end.alias("end"), e.text.alias("text"), n.alias("near")))


def _some(entities: Column, labels: Sequence[str]) -> Column:
    return F.filter(entities, lambda e: e.label.isin(list(labels)))


def _flag(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)


def near_block(entities: Column, against: Sequence[str], towards: Sequence[str], flags: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """From the entities of ``near_names``, those with a name near: n_against and n_towards by label (a label in both counts as against), share_against (0.5
    without any of both), and a 0/1 for each of ``flags``, which only labels of either list set. Three flags make it a block of six."""
    near = F.filter(entities, lambda e: F.size(e.near) > 0)
    n, m = F.size(_some(near, against)), F.size(_some(near, [t for t in towards if t not in against]))
    named = {k: _flag(F.size(_some(near, [x for x in v if x in {*against, *towards}])) > 0) for k, v in flags.items()}
    return {"n_against": n, "n_towards": m, "share_against": F.when(n + m > 0, n / (n + m)).otherwise(F.lit(0.5))} | named


def collision_block(text: Column, names: Column, entities: Column, persons: Sequence[str], place_stems: Sequence[str], common: Sequence[str], person: str = "PERSON", places: Sequence[str] = ("GPE", "LOC")) -> dict[str, Column]:
    """Eight columns on names that are also persons', places' or common words, from the entities of ``near_names``: whether a person is near a name
    that persons bear, a place near a name with one of the stems, a common word stands in lower case (and is one of the names), which of the
    three kinds are named at all, the (person, name near it) pairs, and whether a person's own text holds a name near it. All 0 without names."""
    has = lambda found, listed: F.exists(found, lambda b: F.lower(b).isin([x.lower() for x in listed]))
    stemmed = lambda b: sum((F.when(F.contains(F.lower(b), F.lit(s.lower())), 1).otherwise(0) for s in place_stems), F.lit(0)) > 0
    people = _some(entities, [person])
    small = [has(names, [c]) & text.rlike(rf"(?<![A-Z])\b{re.escape(c.lower())}\b(?![A-Z])") for c in common]
    any_small = F.lit(False)
    for c in small:
        any_small = any_small | F.coalesce(c, F.lit(False))
    return {
        "person_near": _flag(F.exists(people, lambda e: has(e.near, persons))), "place_near": _flag(F.exists(_some(entities, places), lambda e: F.exists(e.near, stemmed))),
        "common_in_lower_case": _flag(any_small), "person_named": _flag(has(names, persons)), "place_named": _flag(F.exists(names, stemmed)), "common_named": _flag(has(names, common)),
        "n_person_near": F.coalesce(F.aggregate(people, F.lit(0), lambda n, e: n + F.size(e.near)), F.lit(0)), "name_in_person": _flag(F.exists(people, lambda e: F.exists(e.near, lambda b: F.contains(F.lower(e.text), F.lower(b))))),
    }


def document_block(entities: Column, org: Sequence[str] = ("ORG",), money: Sequence[str] = ("MONEY",), percent: Sequence[str] = ("PERCENT",), date: Sequence[str] = ("DATE",), place: Sequence[str] = ("GPE", "LOC")) -> dict[str, Column]:
    """Six columns: entities of five kinds in the whole text, and whether organisations stand beside amounts or shares; 0 for null."""
    n = {k: F.coalesce(F.size(_some(entities, v)), F.lit(0)) for k, v in {"n_org": org, "n_money": money, "n_percent": percent, "n_date": date, "n_place": place}.items()}
    n = {k: F.greatest(v, F.lit(0)) for k, v in n.items()}
    return n | {"has_figures": _flag((n["n_org"] > 0) & (n["n_money"] + n["n_percent"] > 0))}


def speech_block(tokens: Column, names: Column, reach: int = 5) -> Column:
    """Five counts around the words that hold a name or that a name holds: nouns behind them, verbs and adjectives before them, finite verbs at most ``reach``
    words from them, and pairs of neighbours there that are verb or adjective or noun, then noun. Tags are Penn's, by their beginnings (NNP is no
    noun for the first count). Sums over prefixes: linear in the words. All 0 for null, and without names."""

    def of(words: Sequence[str], tags: Sequence[str], names: Sequence[str]) -> tuple[int, ...]:
        low, wanted = [w.lower() for w in words], [n.lower() for n in names if n]
        memo: dict[str, bool] = {}
        for w in low:
            if w not in memo:
                memo[w] = any(n in w or w in n for n in wanted)
        at = np.array([i for i, w in enumerate(low) if memo[w]], np.int64)
        if not len(at):
            return 0, 0, 0, 0, 0
        n, starts = len(words), np.array([t[:2] for t in tags], object)
        noun, verb, adjective = np.isin(np.array(tags, object), ["NN", "NNS"]), starts == "VB", starts == "JJ"
        finite, common = np.isin(np.array(tags, object), ["VBD", "VBZ", "VBP"]), starts == "NN"
        pair = np.zeros(n, bool)
        pair[:-1] = (verb | adjective | common)[:-1] & common[1:]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        begin, end = np.maximum(at - reach, 0), np.minimum(at + reach + 1, n)
        near, pairs = upto(finite), upto(pair)
        before, behind = at[at > 0] - 1, at[at + 1 < n] + 1
        return int(noun[behind].sum()), int(verb[before].sum()), int(adjective[before].sum()), int((near[end] - near[begin]).sum()), int((pairs[end - 1] - pairs[begin]).sum())

    fields = ("noun_behind", "verb_before", "adjective_before", "finite_near", "pairs_near")

    @F.arrow_udf(", ".join(f"{f} int" for f in fields))
    def run(words: pa.Array, tags: pa.Array, names: pa.Array) -> pa.Array:
        found = np.zeros((len(words), len(fields)), np.int32)
        for at, to in parts(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), len(words), 1 << 16):  # only a part's words become Python's
            for i, row in enumerate(zip(*(x.slice(at, to - at).to_pylist() for x in (words, tags, names)), strict=True), at):
                if row[0] is not None and row[2]:
                    found[i] = of(*row)
        return pa.StructArray.from_arrays([pa.array(c) for c in found.T.copy()], names=list(fields))

    return run(tokens["word"], tokens["tag"], names)


def label_report(rows: DataFrame, class_col: str, entities_col: str) -> DataFrame:
    """(class, label, n): entities with a name near, by class and label; a row a combination that occurs."""
    near = F.filter(F.col(entities_col), lambda e: F.size(e.near) > 0)
    return rows.select(F.col(class_col).alias("class"), F.explode(near["label"]).alias("label")).groupBy("class", "label").agg(F.count("*").alias("n"))
