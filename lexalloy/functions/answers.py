"""Records and model answers: timestamps, record mapping, repair, validation and look-up of structured answers, prompts,
query strings. Built-in functions only; null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import json_in, json_repaired, let

#: The categories of an answer.
CATEGORIES = ("environmental", "social", "governance", "digital_transformation")
NO_SUMMARY = "No summary provided"
LABEL = "struct<applies:boolean,sentiment:int,evidence:array<string>>"
ANALYSIS = f"struct<brand:string,is_sportswear_brand:boolean,not_sportswear_reason:string,categories:map<string,{LABEL}>,confidence:double,reasoning:string>"
ANSWER = f"struct<brand_analyses:array<{ANALYSIS}>,article_summary:string>"


# time

def compact_timestamp(text: Column) -> Column:
    """``20240131T235959Z`` as a timestamp; null where it isn't one."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{8}T\d{6}Z$"), text), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def iso_timestamp(text: Column) -> Column:
    """ISO 8601, with Z or an offset or neither (which is UTC then); null where it isn't one."""
    plain = F.regexp_replace(text, "Z$", "+00:00")
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), plain))


def compact_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyyMMddHHmmss")


# records of two kinds of news interfaces

RECORD_A = "article_id string, title string, description string, content string, link string, image_url string, pubDate string, source_id string, source_url string, language string, country array<string>, category array<string>, keywords array<string>"
RECORD_B = "url string, title string, seendate string, socialimage string, domain string, language string, sourcecountry string"


def article_of_a(record: Column) -> Column:
    """An article from a JSON record with title, description and content. search_text is what names are looked for in."""
    r = F.from_json(record, RECORD_A)
    search = F.concat_ws(" ", F.coalesce(r.title, F.lit("")), F.coalesce(r.description, F.lit("")), F.coalesce(r.content, F.lit("")))
    fields = [r.article_id.alias("article_id"), r.title.alias("title"), r.description.alias("description"), r.content.alias("content"), r.link.alias("url"), r.image_url.alias("image_url"), iso_timestamp(r.pubDate).alias("published_at"), r.source_id.alias("source_name"), r.source_url.alias("source_url"), r.language.alias("language"), r.country.alias("country"), r.category.alias("category"), r.keywords.alias("keywords"), search.alias("search_text")]
    return F.when(r.isNotNull(), F.struct(*fields))


def article_of_b(record: Column) -> Column:
    """An article from a JSON record without a text; null without a url or title. The id is a hash of the url."""
    r = F.from_json(record, RECORD_B)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    none = F.lit(None).cast("string")
    fields = [F.md5(r.url).alias("article_id"), r.title.alias("title"), none.alias("description"), none.alias("content"), r.url.alias("url"), F.nullif(r.socialimage, F.lit("")).alias("image_url"), compact_timestamp(r.seendate).alias("published_at"), r.domain.alias("source_name"), F.concat(F.lit("https://"), r.domain).alias("source_url"), F.lower(r.language).alias("language"), one(r.sourcecountry).alias("country"), F.array().cast("array<string>").alias("category"), F.array().cast("array<string>").alias("keywords"), r.title.alias("search_text")]
    return F.when((F.coalesce(F.trim(r.url), F.lit("")) != "") & (F.coalesce(F.trim(r.title), F.lit("")) != ""), F.struct(*fields))


# answers

def answer(text: Column) -> Column:
    """The repaired answer in a model's text: trailing commas and bare keys are mended, a single analysis is wrapped, missing
    categories are filled with defaults, a missing summary with a fixed one; null if there is no such JSON."""
    raw = json_repaired(json_in(text))
    whole, single = F.from_json(raw, ANSWER), F.from_json(raw, ANALYSIS)
    wrapped = F.when(single.brand.isNotNull() & single.categories.isNotNull(), F.struct(F.array(single).alias("brand_analyses"), F.coalesce(single.reasoning, F.lit(NO_SUMMARY)).alias("article_summary")))
    filled = F.when(whole.brand_analyses.isNotNull(), F.struct(whole.brand_analyses.alias("brand_analyses"), F.coalesce(whole.article_summary, F.lit(NO_SUMMARY)).alias("article_summary"))).otherwise(wrapped)
    nothing = F.from_json(F.lit('{"applies": false, "evidence": []}'), LABEL)

    def complete(a: Column) -> Column:
        missing = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: ~F.map_contains_key(a.categories, c))
        defaults = F.map_from_entries(F.transform(missing, lambda c: F.struct(c.alias("key"), nothing.alias("value"))))
        more = F.when(a.categories.isNotNull(), F.map_concat(a.categories, defaults))
        defaulted = F.struct(a.brand.alias("brand"), F.coalesce(a.is_sportswear_brand, F.lit(True)).alias("is_sportswear_brand"), a.not_sportswear_reason.alias("not_sportswear_reason"), F.coalesce(more, F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{LABEL}>>"))).alias("categories"), F.coalesce(a.confidence, F.lit(0.0)).alias("confidence"), F.coalesce(a.reasoning, F.lit("")).alias("reasoning"))
        return defaulted

    return let(filled, lambda w: F.when(w.isNotNull(), F.struct(F.transform(w.brand_analyses, complete).alias("brand_analyses"), w.article_summary.alias("article_summary"))))


def faults(analysis: Column) -> Column:
    """What is wrong with an analysis: an array of fault names, empty for a valid one. That a sentiment goes with a category
    that applies isn't asked for."""
    moods = F.exists(F.map_values(analysis.categories), lambda v: v.sentiment.isNotNull() & ~v.sentiment.isin(-1, 0, 1))
    missing = (F.size(analysis.categories) > 0) & F.exists(F.array(*map(F.lit, CATEGORIES)), lambda c: ~F.map_contains_key(analysis.categories, c))
    named = [F.when(F.coalesce(analysis.brand, F.lit("")) == "", F.lit("brand")), F.when(moods, F.lit("sentiment")), F.when(~analysis.confidence.between(0, 1), F.lit("confidence")), F.when(missing, F.lit("categories"))]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def applicable(analysis: Column) -> Column:
    """The categories that apply, in the order of CATEGORIES, then others."""
    keys = F.map_keys(F.map_filter(analysis.categories, lambda _, v: F.coalesce(v.applies, F.lit(False))))
    known = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains(keys, c))
    return F.array_union(known, keys)


def analysis_of(found: Column, brand: Column) -> Column:
    """The first analysis of a brand, case aside; null without one."""
    return F.get(F.filter(found.brand_analyses, lambda a: F.lower(a.brand) == F.lower(brand)), F.lit(0))


# prompts, nested records, query strings

def filled_template(template: Column | str, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by each value (null: empty)."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """One string column for each leaf of df's nested structs, named by its path; arrays and maps as JSON."""

    def leaves(kind: T.StructType, column, path: tuple[str, ...]):
        for f in kind.fields:
            here = column(f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here.getField, (*path, f.name))
            else:
                nested = isinstance(f.dataType, T.ArrayType | T.MapType)
                yield (F.to_json(here) if nested else here.cast("string")).alias(separator.join((*path, f.name)))

    return df.select(*leaves(df.schema, lambda name: F.col(f"`{name}`"), ()))


def packed_terms(terms: Column, most: int, between: str = " OR ", quoted: bool = False, overhead: int = 0) -> Column:
    """An ordered array of terms as an array of ``a OR b`` strings of at most ``most`` characters with their overhead: greedy in
    order, a term that is too long alone stands alone. Terms that hold a space are quoted if asked."""
    word = (lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)) if quoted else (lambda t: t)
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(s: Column, t: Column) -> Column:
        longer = F.concat(s.now, F.lit(between), word(t))
        return F.when(s.now == "", state(s.done, word(t))).when(F.length(longer) + overhead <= most, state(s.done, longer)).otherwise(state(F.concat(s.done, F.array(s.now)), word(t)))

    end = lambda s: F.when(s.now == "", s.done).otherwise(F.concat(s.done, F.array(s.now)))
    return F.aggregate(terms, state(F.array().cast("array<string>"), F.lit("")), step, end)


def query_set(packed: Column, keywords: Sequence[str] = ()) -> Column:
    """One query a packed group, or one for each keyword and group."""
    groups = F.transform(packed, lambda g: F.concat(F.lit("("), g, F.lit(")")))
    if not keywords:
        return groups
    return F.flatten(F.transform(F.array(*map(F.lit, keywords)), lambda k: F.transform(groups, lambda g: F.concat(k, F.lit(" AND "), g))))


def search_url(base: str, query: Column, most: int = 250, start: Column | None = None, end: Column | None = None, timespan: str = "3m") -> Column:
    """A search address; absolute dates, where both are given, win over the timespan."""
    parts = [F.lit(f"{base}?mode=artlist&format=json&maxrecords={min(most, 250)}&query="), F.url_encode(query)]
    span = F.lit(f"&timespan={timespan}")
    if start is not None and end is not None:
        dated = F.concat(F.lit("&startdatetime="), compact_text(start), F.lit("&enddatetime="), compact_text(end))
        span = F.when(start.isNotNull() & end.isNotNull(), dated).otherwise(span)
    return F.concat(*parts, span)


def main_text(html: Column, least: int = 40) -> Column:
    """The readable text of a stored page: scripts, styles, navigation and comments go, block ends become lines, tags go,
    the commonest entities are decoded; lines under ``least`` characters go unless all are."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|nav|header|footer|aside|form)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|h[1-6]|li|tr|section|article|td)\s*>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return let(lines, lambda x: F.array_join(F.when(F.exists(x, lambda y: F.length(y) >= least), F.filter(x, lambda y: F.length(y) >= least)).otherwise(x), "\n"))
