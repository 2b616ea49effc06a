"""Text expressions: built-in functions only, one column in, one out. Null texts give null unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of a paywall.
PAYWALL = ("subscribe to continue", "subscription required", "sign up to read", "become a member", "premium content", "for subscribers only")


def _escaped(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


# vocabulary

def mentioned(text: Column, vocabulary: Sequence[str]) -> Column:
    """Names of the vocabulary that stand in the text as whole words, in the vocabulary's order. One pattern a name, as an alternation would hide overlapping ones.
    The text is put in lower case once, and a pattern looks only at texts that hold its name at all."""
    def hit(lowered: Column, name: str) -> Column:
        return F.when(F.contains(lowered, F.lit(name.lower())) & lowered.rlike(rf"(?U)\b{_escaped(name.lower())}\b"), F.lit(name))

    return let(F.lower(text), lambda lowered: F.filter(F.array(*[hit(lowered, name) for name in vocabulary]), lambda x: x.isNotNull()))


def confirmed(text: Column, expected: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Those of the expected names of which an alias (a pattern; by default the name itself) occurs in the text."""
    lowered = F.lower(text)
    hits = {k: F.lit(False) for k in aliases}
    for name, patterns in aliases.items():
        for p in patterns:
            hits[name] = hits[name] | text.rlike(f"(?i){p}")
    listed = F.array(*[F.when(h, F.lit(k)) for k, h in hits.items()])
    own = lambda name: F.regexp(lowered, F.concat(F.lit(r"(?U)\b\Q"), F.lower(name), F.lit(r"\E\b")))
    return F.filter(expected, lambda name: F.when(name.isin(list(aliases)), F.array_contains(listed, name)).otherwise(own(name)))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    lowered, found = F.lower(text), F.lit(False)
    for p in phrases:
        found = found | F.contains(lowered, F.lit(p.lower()))
    return found


def has_paywall(text: Column) -> Column:
    return contains_any(text, PAYWALL)


def present_keywords(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Category to the keywords that occur as substrings of the lower-case text."""
    lowered = F.lower(text)
    parts = []
    for category, words in keywords.items():
        parts += [F.lit(category), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(lowered, w))]
    return F.create_map(*parts)


def scrape_status(text: Column, language: Column, least: int = 100) -> Column:
    """(status, error) by the first rule that fits: too short, paywall, not English, else success."""
    make = lambda status, error: F.struct(F.lit(status).alias("status"), error.alias("error"))
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < least
    return (
        F.when(short, make("failed", F.lit("content too short"))).when(has_paywall(text), make("skipped", F.lit("paywall")))
        .when(F.coalesce(language, F.lit("en")) != "en", make("skipped", F.concat(F.lit("language "), language))).otherwise(make("success", F.lit(None).cast("string")))
    )


def brand_warning(found: Column, expected: Column, shown: int = 3) -> Column:
    """A warning where names were expected and none was found, which names the first ``shown`` of them; else null."""
    names = F.concat(F.array_join(F.slice(expected, 1, shown), ", "), F.when(F.size(expected) > shown, F.lit(", ...")).otherwise(F.lit("")))
    missing = (F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(found, F.array().cast("array<string>"))) == 0)
    return F.when(missing, F.concat(F.lit("none of the expected names is in the text: "), names))


# choices by a seed

def _drawn(key: Column, seed: int) -> Column:
    """A number of 32 bits that looks random and is always the same for a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def chosen(items: Sequence[str], key: Column, seed: int = 0) -> Column:
    """One of the items a key: a random choice that a retried task makes again."""
    return F.get(F.array(*map(F.lit, items)), F.pmod(_drawn(key, seed), F.lit(len(items))).cast("int"))


def shuffled(items: Column, seed: int = 0) -> Column:
    """An array of strings in a random order that only its items and the seed decide."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(_drawn(x, seed).alias("at"), x.alias("item")))), lambda x: x.item)


# cleaning and assembling

#: A run without white space is a mail address if a ``@`` stands inside it, as ``\S+@\S+`` has it; taken with the white space before it, a run is read
#: once, whatever its length.
_URL, _MAIL = r"https?://\S+|www\.\S+", r"(?:^|\s)\S[^\s@]*+@\S+"


def _without_addresses(text: Column) -> Column:
    """The lower-case text with a space for each url and mail address, and the white space before the latter; the empty text for null."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _URL, " ")
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(out, _MAIL, " ")).otherwise(out)


def cleaned(text: Column, drop_short: bool = True, numbers: bool = False) -> Column:
    """Lower-case letters, digits and single spaces, without urls and mail addresses; words under two characters go if drop_short, digits (each
    run as a space) if numbers."""
    word = ("[a-zA-Z]" if numbers else "[a-zA-Z0-9]") + ("{2,}" if drop_short else "+")
    return F.array_join(F.regexp_extract_all(_without_addresses(text), F.lit(word), F.lit(0)), " ")


def cleaned_with_punctuation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_without_addresses(text), r"""(?U)[^\w\s.,!?;:\-'"()]""", " "), r"\s+", " "))


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def assembled(title: Column, content: Column, brands: Column, source: Column | None = None, categories: Column | None = None, title_weight: int = 1) -> Column:
    """``Source s Category c title content brands``, blank parts left out; the title as often as it weighs."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = [F.concat(F.lit("Source "), filled(source))] if source is not None else []
    parts += [F.concat(F.lit("Category "), filled(F.array_join(categories, " ")))] if categories is not None else []
    return F.concat_ws(" ", *parts, *[filled(title)] * title_weight, filled(content), filled(F.array_join(brands, " ")))


def cut_at(text: Column, size: int, mark: str, keep: float = 0.8, ending: str = "", with_mark: bool = False) -> Column:
    """The text's first size characters, back to the last mark if that lies beyond keep of them; ending follows a cut."""
    head = F.substring(text, 1, size)
    last = F.length(head) - F.locate(mark, F.reverse(head))
    short = F.when((F.locate(mark, F.reverse(head)) > 0) & (last > keep * size), F.substring(head, F.lit(1), last + (1 if with_mark else 0))).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(short, F.lit(ending)))


def without_symbols(text: Column) -> Column:
    """Without pictographs: all characters beyond the basic plane, and U+24C2 to U+1F251 (which holds CJK too); spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}\x{24C2}-\x{FFFF}\x{2600}-\x{27BF}]", ""), r"\s+", " "))


# words around names

def words_around(text: Column, names: Sequence[str] | Column, reach: int) -> Column:
    """The lower-case words at most reach away from a one-word name, names left out, in order. names: given ones, or a row's own (an array)."""
    if isinstance(names, Column):
        own = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.lower(n))
    else:
        own = F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>")

    def near(words: Column, own: Column) -> Column:
        is_name = lambda w: F.coalesce(F.array_contains(own, w), F.lit(False))
        at = F.filter(F.transform(words, lambda w, i: F.when(is_name(w), i)), lambda i: i.isNotNull())
        # the windows' places, each once: they rise, as the windows do
        places = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - reach, F.lit(0)), F.least(p + reach, F.size(words) - 1)))))
        return F.filter(F.transform(places, lambda i: F.get(words, i)), lambda w: ~is_name(w))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.array_join(let(F.struct(words.alias("words"), own.alias("own")), lambda x: near(x.words, x.own)), " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


# structured text

def json_in(text: Column) -> Column:
    """The first fenced block that holds a brace, else the widest braced part; null if there is none."""
    fenced = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.lit(1)), lambda b: F.contains(b, F.lit("{")))
    return F.coalesce(F.trim(F.get(fenced, F.lit(0))), F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def json_repaired(text: Column) -> Column:
    """Without trailing commas, with quoted keys."""
    out = F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")
    return F.regexp_replace(out, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')


def listed(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 0, F.lit("")).when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))


def version(text: Column) -> Column:
    """``v2`` and ``2.1.3`` as an array of three numbers, which compares as versions do; null if it is neither."""
    plain = F.regexp_extract(text, r"^v?(\d+(?:\.\d+){0,2})$", 1)
    parts = F.transform(F.split(plain, r"\."), lambda p: p.cast("int"))
    return F.when(F.length(plain) > 0, F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0))), 1, 3))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal size or without length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def snippet(text: Column, excerpt: Column, reach: int = 100) -> Column:
    """The excerpt (or, where it isn't found, its first five words) with reach characters around it, cut at spaces, ``...`` where
    something is cut off; the text's beginning where neither is found."""
    words = F.array_join(F.slice(F.filter(F.split(excerpt, r"\s+"), lambda w: w != ""), 1, 5), " ")
    whole = F.position(F.lower(excerpt), F.lower(text))
    at = F.when(whole > 0, whole).otherwise(F.position(F.lower(words), F.lower(text))) - 1
    size, n = F.length(excerpt), F.length(text)
    head = F.when(n <= 2 * reach, text).otherwise(F.concat(F.substring(text, 1, 2 * reach), F.lit("...")))

    def around(x: Column) -> Column:
        after = F.position(F.lit(" "), text, x.begin + 1) - 1  # the next space, which must stand before the excerpt
        begin = F.when((x.begin > 0) & (after >= 0) & (after < x["at"]), after + 1).otherwise(x.begin)
        tail = F.substring(text, x["at"] + size + 1, x.end - x["at"] - size)
        last = F.length(tail) - F.position(F.lit(" "), F.reverse(tail))
        end = F.when((x.end < n) & (F.position(F.lit(" "), F.reverse(tail)) > 0), x["at"] + size + last).otherwise(x.end)
        body = F.regexp_replace(F.substring(text, begin + 1, end - begin), r"(?U)^\s+|\s+$", "")
        return F.concat(F.when(begin > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < n, F.lit("...")).otherwise(F.lit("")))

    place = F.struct(at.alias("at"), F.greatest(at - reach, F.lit(0)).alias("begin"), F.least(at + size + reach, n).alias("end"))
    return F.when(at < 0, head).otherwise(let(place, around))


def windows_around(text: Column, phrases: Sequence[str], reach: int = 20) -> Column:
    """The lower-case words up to reach before and behind each place where a phrase stands as a substring, window after window
    (overlaps are repeated), phrases in order; the empty text without one."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")

    def of(phrase: str) -> Column:
        pieces = F.split(lowered, rf"\Q{phrase}\E", -1)

        def side(near: Column, whole: bool | Column, all_of_it: Column) -> Column:
            """The words of the nearest pieces; of all pieces only where these hold too few (the phrase stands in words without white space)."""
            return let(split(near), lambda w: F.when(whole | (F.size(w) > reach), w).otherwise(split(all_of_it)))

        def window(i: Column) -> Column:
            first = F.greatest(i - 1 - reach, F.lit(1))
            before = side(F.array_join(F.slice(pieces, first, i - first), phrase), first == 1, F.array_join(F.slice(pieces, F.lit(1), i - 1), phrase))
            behind = side(F.array_join(F.slice(pieces, i, F.lit(reach + 1)), phrase), i + reach >= F.size(pieces), F.array_join(F.slice(pieces, i, F.size(pieces)), phrase))
            near = let(before, lambda w: F.slice(w, F.greatest(F.size(w) - reach + 1, F.lit(1)), F.lit(reach)))
            return F.concat(near, F.array(F.lit(phrase)), F.slice(behind, F.lit(1), F.lit(reach)))

        return F.when(F.size(pieces) > 1, F.flatten(F.transform(F.sequence(F.lit(2), F.size(pieces)), window))).otherwise(F.array().cast("array<string>"))

    parts = [of(p.lower()) for p in phrases]
    return F.array_join(F.concat(*parts), " ")


def mood(sentiment: Column) -> Column:
    return F.when(sentiment == 1, F.lit("positive")).when(sentiment == 0, F.lit("neutral")).when(sentiment == -1, F.lit("negative"))


def checked_share(value: Column, name: str = "probability") -> Column:
    """The value; an error outside [0, 1]."""
    return F.when(value.isNull() | value.between(0, 1), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} outside [0, 1]: "), value.cast("string"))).cast("double"))


def confidence_label(probability: Column) -> Column:
    """low under 0.3, medium under 0.6, else high; an error outside [0, 1]."""
    return let(checked_share(probability), lambda p: F.when(p < 0.3, F.lit("low")).when(p < 0.6, F.lit("medium")).when(p.isNotNull(), F.lit("high")))


def bumped(current: Column, part: str = "minor") -> Column:
    """The next version of an array of three numbers, as text."""
    major, minor, patch = (F.get(current, F.lit(i)) for i in range(3))
    parts = {"major": (major + 1, F.lit(0), F.lit(0)), "minor": (major, minor + 1, F.lit(0)), "patch": (major, minor, patch + 1)}[part]
    return F.concat(F.lit("v"), F.concat_ws(".", *[p.cast("string") for p in parts]))


def english(text: Column, detected: Column, least: int = 100) -> Column:
    """Whether a text counts as English: short ones and those without a detected language do."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < least) | (F.coalesce(detected, F.lit("en")) == "en")


def likeliest_language(text: Column, profiles: Mapping[str, Sequence[str]]) -> Column:
    """The language with most of its stop words among the text's words; null where no word is one. The default detector; any
    column of language codes can stand in its place."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w']+"), lambda w: w != "")
    among = lambda p: lambda x: x.isin(list(p))
    counts = lambda w: F.array(*[F.struct(F.size(F.filter(w, among(p))).alias("n"), F.lit(name).alias("name")) for name, p in profiles.items()])
    best = let(let(words, counts), lambda c: F.array_max(c))
    return F.when(best["n"] > 0, best["name"])


def explained(brand: Column, categories: Column, n_evidence: Column, moods: Column) -> Column:
    """A sentence on what a label rests on; null without evidence."""
    sentence = F.concat(brand, F.lit(": "), listed(categories), F.lit(" ("), n_evidence.cast("string"), F.when(n_evidence == 1, F.lit(" excerpt")).otherwise(F.lit(" excerpts")), F.lit("), sentiment "), F.coalesce(listed(F.array_distinct(moods)), F.lit("unclear")), F.lit("."))
    return F.when((n_evidence > 0) & (F.size(categories) > 0), sentence)
