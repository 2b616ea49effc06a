"""A document's fields put together as one text, the ways models are trained on it and served it. Built-in functions only.

Blank fields (null or empty) are left out unless a function says otherwise; ``brands`` and ``categories`` are arrays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import assembled, cleaned, let, words_around


def _filled(part: Column) -> Column:
    return F.nullif(part, F.lit(""))


def _names(items: Column) -> Column:
    """An array's filled items, joined by spaces."""
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), " ")


def metadata_prefix(source: Column, categories: Column) -> Column:
    """``source category category `` with a space at its end; empty where both are blank."""
    words = F.concat_ws(" ", _filled(source), _filled(_names(categories)))
    return F.when(words != "", F.concat(words, F.lit(" "))).otherwise(words)


class Cleaned(NamedTuple):
    """Title (null where it is null), content and brands cleaned, and the cleaned words near the brands (null where there are no brands)."""

    title: Column
    content: Column
    brands: Column
    near: Column


def cleaned_fields(title: Column, content: Column, brands: Column, reach: int = 10) -> Cleaned:
    near = F.when(F.size(brands) > 0, let(words_around(content, brands, reach), lambda words: cleaned(words)))
    return Cleaned(F.when(title.isNotNull(), cleaned(title)), cleaned(content), cleaned(_names(brands)), near)


def with_cleaned(df: DataFrame, title: Column, content: Column, brands: Column, reach: int = 10) -> tuple[DataFrame, Cleaned]:
    """df with columns of the cleaned fields, and these: given to several texts, each field is cleaned once a row and not once a text."""
    made = {f"cleaned_{k}": c for k, c in cleaned_fields(title, content, brands, reach)._asdict().items()}
    return df.withColumns(made), Cleaned(*map(F.col, made))


def training_text(title: Column, content: Column, brands: Column, source: Column | None = None, categories: Column | None = None, clean: Cleaned | None = None) -> Column:
    """Source and categories as they are, then title (twice), brands and content cleaned. Only a null title is left out: other
    fields keep their place, so that a blank one leaves its space. clean: the fields of ``with_cleaned``."""
    return F.concat_ws(" ", *_prefix(source, categories), *_body(clean or cleaned_fields(title, content, brands)))


def emphasised_text(title: Column, content: Column, brands: Column, reach: int = 10, clean: Cleaned | None = None) -> Column:
    """Title (twice), brands and content cleaned, then once more the words of the content that stand near one of its brands. clean: as above, which
    then has its own reach."""
    clean = clean or cleaned_fields(title, content, brands, reach)
    return F.concat_ws(" ", *_body(clean), _filled(clean.near))


def raw_text(title: Column, content: Column, brands: Column, source: Column | None = None, categories: Column | None = None) -> Column:
    """Nothing cleaned: the prefix, then title, content and brands."""
    body = F.concat_ws(" ", _filled(title), _filled(content), _filled(_names(brands)))
    return body if source is None and categories is None else F.concat(_whole_prefix(source, categories), body)


def labelled_text(title: Column, content: Column, brands: Column, source: Column, categories: Column) -> Column:
    """As served with named fields: ``Source s Category c title content brands``."""
    return assembled(title, content, brands, source, categories)


def weighted_text(title: Column, content: Column, brands: Column, source: Column, categories: Column, clean: Cleaned | None = None) -> Column:
    """As served with a weighted title: the prefix, title (twice), brands and content cleaned, all blanks left out. clean: as above."""
    title, content, brands = map(_filled, (clean or cleaned_fields(title, content, brands))[:3])
    return F.concat_ws(" ", *_prefix(source, categories), title, title, brands, content)


def _whole_prefix(source: Column | None, categories: Column | None) -> Column:
    held = F.lit(None).cast("string") if source is None else source
    return metadata_prefix(held, F.array().cast("array<string>") if categories is None else categories)


def _prefix(source: Column | None, categories: Column | None) -> list[Column]:
    return [] if source is None and categories is None else [_filled(F.rtrim(_whole_prefix(source, categories)))]


def _body(clean: Cleaned) -> list[Column]:
    return [clean.title, clean.title, clean.brands, clean.content]
