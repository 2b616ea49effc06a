"""Secret scans (operator 6): base patterns and a randomness test battery. DataFrame functions only.

Base: three fixed patterns, leftmost and non-overlapping each, kept if long enough.

Battery: all tokens of 16 characters or more outside base spans are tested. For each, the narrowest encoding that holds
all its characters is inferred (hex, base 32, base 36, base 62, base 64), and

- the chi-squared statistic of its characters against a uniform alphabet, standardised;
- the number of changes between runs of digits and of letters; in tokens without a digit or without a letter, of changes
  of case, where a word (three small letters or more, the first one may be a capital before them) counts as one run;
- the lag-1 serial correlation of its characters' places in the alphabet, standardised,

are held against how natural tokens behave: for the first and third, median and quartiles over the corpus's letters-only
tokens of the same length class that are cased as words are (so keys of mixed case are not among them, and others
can't shift it; a class without such tokens takes those of the nearest class, and where there are none at all, these two
tests say nothing, p = 1), for the second, a Poisson count of ``natural_changes``. Fisher's method makes the three p-values one;
Benjamini and Hochberg's step-up rule, applied in each length class to tokens with digits and letters and to all others
(from a histogram of p-values, so nothing but bounded counts is gathered), keeps the expected share of false finds under ``q``.

Defined results: a null text counts as empty; repeated rows are scanned each; an empty table gives an empty table;
columns of docs other than id and text are ignored; a very long token is tested whole, in the last length class. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: The base patterns, the group whose length counts, and the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
KINDS = (*BASE, "random")

TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Length classes: from this length on.
CLASSES = (16, 20, 24, 32, 48)
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, narrowest first: pattern, alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", _UPPER + "234567"), ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER), ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER), (".", _DIGITS + _UPPER + _LOWER + "+/-_"),
)
_BLOCK = 64


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The matches of pattern, leftmost and non-overlapping, whose group is long enough: array of (start, end, value)."""
    pieces, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("own")))

    def placed(x: Column) -> Column:
        """Beginnings from running sums, in blocks, so that many matches in one text don't cost their square."""
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, s: a + s.gap + s.own)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        ahead = F.aggregate(blocks, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return let(ahead, lambda sums: F.transform(x, lambda s, i: F.struct(
            (F.get(sums, F.floor(i / _BLOCK).cast("int")) + total(F.slice(x, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK)))) + s.gap).alias("start"), s.own.alias("own"))))

    found = F.zip_with(let(steps, placed), value, lambda s, v: F.struct(s.start.alias("start"), (s.start + s.own).alias("end"), v.alias("value")))
    kept = F.filter(found, lambda s: F.length(s.value) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), by start and then by kind as listed; kind is its place in KINDS."""
    def of_kind(kind: str) -> Column:
        place = KINDS.index(kind)
        return F.transform(spans(text, *BASE[kind]), lambda s: F.struct(s.start.alias("start"), F.lit(place).alias("kind"), s.end.alias("end")))

    parts = [of_kind(kind) for kind in BASE]
    return F.sort_array(F.concat(*parts))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")


def statistics(tokens: DataFrame) -> DataFrame:
    """tokens (with value) and length_class, mixed (digits and letters), natural (cased as a word), chi, changes, serial."""
    encoded = F.lit(None)
    for pattern, alphabet in reversed(ENCODINGS):
        encoded = F.when(F.col("body").rlike(pattern), F.lit(alphabet)).otherwise(encoded)
    bounds = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        bounds = F.when(F.length("value") >= c, F.lit(c)).otherwise(bounds)
    coded = tokens.withColumn("body", F.rtrim(F.col("value"), F.lit("="))).withColumns({"alphabet": encoded, "length_class": bounds, "mixed": F.col("body").rlike("[0-9]") & F.col("body").rlike("[A-Za-z]"), "natural": F.col("body").rlike("^([A-Za-z]?[a-z]+|[A-Z]+)$")})
    coded = coded.withColumns({"size": F.length("alphabet").cast("double"), "n": F.length("body").cast("double"), "places": F.transform(F.split("body", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))})
    squares = F.aggregate(F.array_distinct("places"), F.lit(0.0), lambda a, p: a + F.pow(F.size(F.filter("places", lambda x: x == p)).cast("double"), 2))
    coded = coded.withColumns({"squares": squares, "mean": F.aggregate("places", F.lit(0.0), lambda a, p: a + p) / F.col("n")})
    free = F.col("size") - 1
    chi = (F.col("size") / F.col("n") * F.col("squares") - F.col("n") - free) / F.sqrt(2 * free)
    centred = F.transform("places", lambda p: p - F.col("mean"))
    coded = coded.withColumn("centred", centred)
    products = F.aggregate(F.zip_with("centred", F.slice("centred", 2, F.size("centred")), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    variance = F.aggregate("centred", F.lit(0.0), lambda a, v: a + v * v)
    serial = F.when(variance > 0, products / variance).otherwise(F.lit(1.0)) * F.sqrt("n")
    marked = F.translate(F.col("body"), _DIGITS + _UPPER + _LOWER, "0" * 10 + "a" * 52)
    changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "[^0a]", ""), "0+", "0"), "a+", "a")) - 1
    letters = F.regexp_replace(F.regexp_replace("body", "[A-Z]?[a-z]{3,}", "a"), "[^A-Za-z]", "")
    cases = F.greatest(F.length(F.regexp_replace(F.regexp_replace(letters, "[a-z]+", "a"), "[A-Z]+", "A")) - 1, F.lit(0))
    return coded.withColumns({"chi": chi, "serial": serial, "changes": F.when(F.col("mixed"), changes).otherwise(cases)}).drop("body", "alphabet", "size", "n", "places", "squares", "mean", "centred")


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a normal Z: the error function's rational approximation (error under 1.5e-7), at least 1e-12."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    upper = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-12))


def random_tokens(tokens: DataFrame, q: float, natural_changes: float) -> DataFrame:
    """The tokens that the battery finds random at false-discovery rate q in their length class, with digits and letters or not."""
    measured = stored(statistics(tokens), "tokens")
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    nulls = measured.filter("natural").groupBy("length_class").agg(quartiles("chi").alias("chi"), quartiles("serial").alias("serial"))
    nulls = nulls.select("length_class", *[f(F.col(c)).alias(f"{c}_{n}") for c in ("chi", "serial") for n, f in (("mean", lambda q: q[1]), ("std", lambda q: (q[2] - q[0]) / 1.349))])
    nulls = {r["length_class"]: r for r in nulls.collect()}

    def z(stat: str) -> Column:
        """Distance from the natural tokens' median; null without natural tokens to compare with."""
        usable = {c: (float(r[f"{stat}_mean"]), float(r[f"{stat}_std"])) for c, r in nulls.items() if (r[f"{stat}_std"] or 0) > 0.05}
        out = F.lit(None).cast("double")
        for c in CLASSES if usable else ():
            mean, std = usable[min(usable, key=lambda k: abs(math.log(k / c)))]  # the nearest length class that has natural tokens
            out = F.when(F.col("length_class") == c, (F.col(stat) - mean) / std).otherwise(out)
        return out

    p_chi = F.coalesce(normal_tail(-z("chi")), F.lit(1.0))
    p_serial = F.coalesce(F.least(2 * normal_tail(F.abs(z("serial"))), F.lit(1.0)), F.lit(1.0))
    under = sum((math.exp(-natural_changes) * natural_changes**k / math.factorial(k) * F.when(F.col("changes") > k, 1.0).otherwise(0.0) for k in range(16)), F.lit(0.0))
    p_changes = F.greatest(1 - under, F.lit(1e-12))
    half = -(F.log(p_chi) + F.log(p_serial) + F.log(p_changes))
    combined = F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-30))  # chi-squared, 6 degrees of freedom
    scored = measured.withColumn("level", F.floor(-10 * F.log10(combined)).cast("int"))
    counts: dict[tuple[int, bool], dict[int, int]] = {}
    for c, mixed, level, n in scored.groupBy("length_class", "mixed", "level").agg(F.count("*")).collect():
        counts.setdefault((c, mixed), {})[level] = n
    enough = F.lit(False)
    for (c, mixed), levels in counts.items():
        tests, found, least = sum(levels.values()), 0, None
        for level in sorted(levels, reverse=True):
            found += levels[level]
            if tests * 10 ** (-level / 10) <= q * found:
                least = level
        if least is not None:
            enough = enough | ((F.col("length_class") == c) & (F.col("mixed") == mixed) & (F.col("level") >= least))
    return scored.filter(enough)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.001, natural_changes: float = 1.0, row: Column | None = None) -> DataFrame:
    """row (unique, unless given), id, base and spans (arrays of start, kind, end) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col), base_spans(text).alias("base"), spans(text, TOKEN).alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b.start < t.end) & (t.start < b.end)))
    rows = stored(rows.withColumn("tokens", free), "scan")
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.value")
    added = random_tokens(tokens, q, natural_changes).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("added"))
    both = rows.select("row", id_col, "base").join(added, "row", "left")
    return both.select("row", id_col, "base", F.sort_array(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[redacted]") -> Column:
    """text with its spans (sorted by start; they may overlap) replaced by a mark each. Parts are joined in blocks, so that
    many spans in one text don't cost their square."""
    state = lambda at, parts: F.struct(at.alias("at"), parts.alias("parts"))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        part = F.when(x.start >= s["at"], F.array(F.substring(text, s["at"] + 1, x.start - s["at"]), F.lit(mark))).otherwise(none)
        return state(F.greatest(s["at"], x.end), F.concat(s.parts, part))

    def block(s: Column, spans_: Column) -> Column:
        done = F.aggregate(spans_, state(s["at"], none), step, lambda x: state(x["at"], F.array(F.array_join(x.parts, ""))))
        return let(done, lambda d: state(d["at"], F.concat(s.parts, d.parts)))

    last = F.floor((F.size(found) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(found, b * _BLOCK + 1, F.lit(_BLOCK)))
    whole = lambda s: F.concat(F.array_join(s.parts, ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(blocks, state(F.lit(0), none), block, whole)).otherwise(text)
