"""Text features as columns: rule tables, vocabulary counts, distances between words, metadata, and TF-IDF weights. Vocabularies and patterns are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, mentioned
from ..sources.files import checkpoint_dir

_EDGE = r"""^[.,!?;:'"()\[\]{}]+|[.,!?;:'"()\[\]{}]+$"""


@dataclass(frozen=True)
class Rule:
    """A flag: at least least of the patterns match, and, where a brand is given, the text mentions it."""

    name: str
    patterns: tuple[str, ...]
    weight: float = 1.0
    least: int = 1
    brand: str | None = None


def rule_flags(text: Column, rules: Sequence[Rule], ignore_case: bool = True) -> dict[str, Column]:
    """A 0/1 column for each rule, n_rules (how many fit, those of negative weight aside) and score (their weights' sum)."""
    prefix, flags = "(?i)" if ignore_case else "", {}
    for rule in rules:
        hits = sum((F.when(text.rlike(prefix + p), 1).otherwise(0) for p in rule.patterns), F.lit(0))
        fits = hits >= rule.least
        if rule.brand is not None:
            fits = fits & (F.size(mentioned(text, [rule.brand])) > 0)
        flags[rule.name] = F.when(F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    count = sum((flags[r.name] for r in rules if r.weight > 0), F.lit(0))
    score = sum((flags[r.name] * F.lit(float(r.weight)) for r in rules), F.lit(0.0))
    return flags | {"n_rules": count, "score": score}


def bare_words(text: Column) -> Column:
    """White-space separated lower-case words without punctuation at their ends."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, _EDGE, ""))


def vocabulary_counts(text: Column, categories: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Distinct words of each category in the text, whether any, and the total."""
    words = F.array_distinct(bare_words(text))
    counts = {name: F.size(F.array_intersect(words, F.array(*[F.lit(w.lower()) for w in vocabulary]))) for name, vocabulary in categories.items()}
    flags = {f"has_{name}": F.when(c > 0, 1).otherwise(0) for name, c in counts.items()}
    return {f"n_{name}": c for name, c in counts.items()} | flags | {"n_vocabulary": sum(counts.values(), F.lit(0))}


def places_of(words: Column, names: Sequence[str]) -> Column:
    listed = [n.lower() for n in names]
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(listed), i)), lambda i: i.isNotNull())


def proximity(text: Column, names: Sequence[str], keywords: Sequence[str], reach: int = 15) -> Column:
    """(min_distance, mean_distance, n_near, any_near) in words between one-word names and keywords: least distance, mean over
    mentions of the distance to the nearest keyword, pairs at most reach apart; 100, 100, 0, 0 where either is missing."""
    missing = F.struct(F.lit(100.0).alias("min_distance"), F.lit(100.0).alias("mean_distance"), F.lit(0).alias("n_near"), F.lit(0).alias("any_near"))

    def measured(x: Column) -> Column:
        nearest = F.transform(x.a, lambda p: F.array_min(F.transform(x.b, lambda q: F.abs(p - q))))
        near = F.aggregate(F.transform(x.a, lambda p: F.size(F.filter(x.b, lambda q: F.abs(p - q) <= reach))), F.lit(0), lambda s, n: s + n)
        mean = F.aggregate(nearest, F.lit(0.0), lambda s, n: s + n) / F.size(x.a)
        found = F.struct(F.array_min(nearest).cast("double").alias("min_distance"), mean.alias("mean_distance"), near.alias("n_near"), F.when(near > 0, 1).otherwise(0).alias("any_near"))
        return F.when((F.size(x.a) > 0) & (F.size(x.b) > 0), found).otherwise(missing)

    return let(bare_words(text), lambda w: let(F.struct(places_of(w, names).alias("a"), places_of(w, keywords).alias("b")), measured))


def negative_context(text: Column, names: Sequence[str], negative: Sequence[str], positive: Sequence[str], reach: int = 15) -> Column:
    """(n_negative, n_negative_near, negative_share, mostly_negative); a share of 0.5 where neither kind is near."""

    def measured(x: Column) -> Column:
        near = lambda places: F.aggregate(F.transform(x.a, lambda p: F.size(F.filter(places, lambda q: F.abs(p - q) <= reach))), F.lit(0), lambda s, n: s + n)
        n, p = near(x.n), near(x.p)
        share = F.when(n + p > 0, n / (n + p)).otherwise(F.lit(0.5))
        return F.struct(F.size(x.n).alias("n_negative"), n.alias("n_negative_near"), share.alias("negative_share"), F.when(n > p, 1).otherwise(0).alias("mostly_negative"))

    return let(bare_words(text), lambda w: let(F.struct(places_of(w, names).alias("a"), places_of(w, negative).alias("n"), places_of(w, positive).alias("p")), measured))


def keyword_clusters(text: Column, keywords: Sequence[str], reach: int = 15) -> Column:
    """(density for each 100 words, most keywords in reach words from one on, mean gap between neighbouring ones)."""

    def measured(x: Column) -> Column:
        cluster = F.array_max(F.transform(x.k, lambda p: F.size(F.filter(x.k, lambda q: (q >= p) & (q - p <= reach)))))
        gap = F.when(F.size(x.k) > 1, (F.element_at(x.k, -1) - F.get(x.k, F.lit(0))) / (F.size(x.k) - 1))
        density = F.when(x.n > 0, 100.0 * F.size(x.k) / x.n).otherwise(F.lit(0.0))
        return F.struct(density.alias("density"), F.coalesce(cluster, F.lit(0)).alias("largest_cluster"), gap.alias("mean_gap"))

    return let(bare_words(text), lambda w: let(F.struct(places_of(w, keywords).alias("k"), F.size(w).alias("n")), measured))


def multi_hot(text: Column, vocabulary: Sequence[str]) -> Column:
    """0/1 for each name of the vocabulary, in its order."""
    return let(mentioned(text, vocabulary), lambda found: F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(found, v).cast("int")))


def source_reputation(source: Column, scores: Sequence[tuple[str, float]], default: float = 0.35) -> Column:
    """The score of the first domain that the source's name holds."""
    out = F.lit(default)
    for domain, score in reversed(scores):
        out = F.when(F.contains(F.lower(source), F.lit(domain)), F.lit(score)).otherwise(out)
    return out


def tf_idf(docs: DataFrame, id_col: str, text_col: str, pattern: str = r"[a-zA-Z][a-zA-Z]+", stop_words: Sequence[str] = (), min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """(id, term, weight): words and pairs of words with weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document's vector of
    length 1. Terms in fewer than min_df documents or more than the share max_df are left out; the max_features most frequent ones stay."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(list(stop_words)) if stop_words else F.lit(True))
    pairs = lambda w: F.concat(w, F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))
    return weighted_terms(docs, id_col, let(words, pairs), min_df, max_df, max_features)


def vocabulary_near(text: Column, names: Sequence[str], categories: Mapping[str, Sequence[str]], reach: int = 15) -> dict[str, Column]:
    """n_near_{category}: how many distinct words of the category stand at most reach words from a one-word name."""

    def near(words: Column, places: Column, vocabulary: Sequence[str]) -> Column:
        close = F.filter(words, lambda w, i: w.isin([v.lower() for v in vocabulary]) & F.exists(places, lambda p: F.abs(p - i) <= reach))
        return F.size(F.array_distinct(close))

    def counted(words: Column) -> Column:  # places are found once a text, not once a word
        return let(places_of(words, names), lambda places: F.struct(*[near(words, places, v).alias(f"n_near_{k}") for k, v in categories.items()]))

    found = let(bare_words(text), counted)
    return {f"n_near_{name}": found[f"n_near_{name}"] for name in categories}


def brand_summary(brands: Column, problematic: Sequence[str]) -> dict[str, Column]:
    """n_brands, n_problematic, any_problematic of an array of names."""
    n = F.size(F.array_intersect(F.coalesce(brands, F.array().cast("array<string>")), F.array(*map(F.lit, problematic))))
    return {"n_brands": F.greatest(F.size(F.coalesce(brands, F.array().cast("array<string>"))), F.lit(0)), "n_problematic": n, "any_problematic": (n > 0).cast("int")}


def metadata(source: Column, categories: Column, publishers: Mapping[str, Sequence[str]], topics: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """from_{list} where the source's name holds a publisher of the list, topic_{t} where a category is one of the topic's, and
    the number of categories; nulls count as nothing."""
    held = F.coalesce(categories, F.array().cast("array<string>"))
    lowered, names = F.lower(F.coalesce(source, F.lit(""))), F.transform(held, lambda c: F.lower(c))
    out = {f"from_{k}": F.exists(F.array(*[F.lit(p.lower()) for p in v]), lambda p: F.contains(lowered, p)).cast("int") for k, v in publishers.items()}
    out |= {f"topic_{k}": F.arrays_overlap(names, F.array(*[F.lit(t.lower()) for t in v])).cast("int") for k, v in topics.items()}
    return out | {"n_categories": F.size(held), "has_categories": (F.size(held) > 0).cast("int")}


def substring_vocabulary(text: Column, categories: Mapping[str, Sequence[str]], others: Sequence[str] = ()) -> dict[str, Column]:
    """How many keywords of each category occur as substrings of the lower-case text, whether any does, their total, that of the
    other keywords, and the share of the former (0.5 without either)."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(lowered, w))) if words else F.lit(0)
    counts = {k: count(v) for k, v in categories.items()}
    total, other = sum(counts.values(), F.lit(0)), count(others)
    share = F.when(total + other > 0, total / (total + other)).otherwise(F.lit(0.5))
    return {f"n_{k}": c for k, c in counts.items()} | {f"has_{k}": (c > 0).cast("int") for k, c in counts.items()} | {"n_total": total, "n_other": other, "share": share}


def several_categories(text: Column, categories: Mapping[str, Sequence[str]], least: int = 2) -> Column:
    """1 where words of at least ``least`` categories occur in the text."""
    words = F.array_distinct(bare_words(text))
    hits = lambda w: sum((F.arrays_overlap(w, F.array(*[F.lit(v.lower()) for v in vocabulary])).cast("int") for vocabulary in categories.values()), F.lit(0))
    return (let(words, hits) >= least).cast("int")


def headline(title: Column, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """For each group of patterns whether one matches the title (case aside) and how many do."""
    text = F.coalesce(title, F.lit(""))
    counts = {k: sum((text.rlike("(?i)" + p).cast("int") for p in v), F.lit(0)) for k, v in groups.items()}
    return {f"n_{k}": c for k, c in counts.items()} | {f"is_{k}": (c > 0).cast("int") for k, c in counts.items()}


def characters(text: Column, sizes: tuple[int, int] = (3, 5)) -> Column:
    """The character n-grams of a lower-case text whose runs of white space are one space, sizes from the first to the last."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    of = lambda t, n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return let(plain, lambda t: F.concat(*[of(t, n) for n in range(sizes[0], sizes[1] + 1)]))


def weighted_terms(docs: DataFrame, id_col: str, terms: Column, min_df: int = 2, max_df: float = 0.95, max_features: int = 10_000) -> DataFrame:
    """(id, term, weight) as ``tf_idf`` weighs, of any array of terms.

    Terms are counted over all documents first; only the most frequent ones are counted by document, twice as many as can stay, and more for as long as
    too many of them are in too few or too many documents. So what is shuffled by document is the vocabulary's share, not each term once a document."""
    checkpoint_dir(docs.sparkSession)
    n, asked = docs.count(), 2 * max_features
    seen = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("cf")).filter(F.col("cf") >= min_df)
    while True:
        first = seen.orderBy(F.desc("cf"), "term").limit(asked).checkpoint()  # bounded by the vocabulary's bound, which is the feature
        few = (lambda df: F.broadcast(df)) if asked <= 400_000 else (lambda df: df)  # a larger vocabulary isn't broadcast
        counts = docs.select(id_col, F.explode(terms).alias("term")).join(few(first.select("term")), "term").groupBy(id_col, "term").agg(F.count("*").alias("tf")).checkpoint()
        df = counts.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        kept = df.join(few(first), "term").orderBy(F.desc("cf"), "term").limit(max_features).checkpoint()
        if kept.count() == max_features or first.count() < asked:
            break
        asked *= 4
    weight = (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weighted = counts.filter(F.col(id_col).isNotNull()).join(few(kept), "term").select(id_col, "term", weight.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def vectors(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, features): one sparse vector a document, as long as the vocabulary (which max_features bounds), places by the terms' order."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    terms = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]
    numbers = weights.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    few = F.broadcast(numbers) if len(terms) <= 200_000 else numbers
    placed = weights.join(few, "term").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("m"))
    size = max(len(terms), 1)
    sparse = F.udf(lambda places, values: Vectors.sparse(size, places, values), VectorUDT())  # no built-in function makes a sparse vector
    return placed.select(id_col, sparse("m.place", "m.weight").alias("features"))


def latent(rows: DataFrame, components: int, features: str = "features") -> DataFrame:
    """rows with ``latent``: their features projected on the first right singular vectors (truncated SVD, as the rows aren't
    centred); see ``latent.factorised``, which keeps rows sparse."""
    from pyspark.ml.functions import array_to_vector

    from . import latent as factors

    out = factors.factorised(rows, components, features).apply(rows, features)
    return out.withColumn("latent", array_to_vector("latent"))


def assembled_blocks(df: DataFrame, blocks: Mapping[str, Sequence[str]], fit_on: Column | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with ``features``: each block's columns scaled (fitted on the rows of fit_on only) and put side by side, and the names of the
    columns by block, in the order of their places."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = []
    for name, columns in blocks.items():
        stages += [VectorAssembler(inputCols=list(columns), outputCol=f"_{name}_raw", handleInvalid="keep"), StandardScaler(inputCol=f"_{name}_raw", outputCol=f"_{name}", withMean=True)]
    stages.append(VectorAssembler(inputCols=[f"_{n}" for n in blocks], outputCol="features"))
    numeric = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for columns in blocks.values() for c in columns})
    model = Pipeline(stages=stages).fit(numeric if fit_on is None else numeric.filter(fit_on))
    return model.transform(numeric).drop(*[f"_{n}{x}" for n in blocks for x in ("", "_raw")]), {k: list(v) for k, v in blocks.items()}


def top_words(words: DataFrame, group: str, stop_words: Sequence[str], n: int) -> DataFrame:
    """(group, word, n): the n commonest words of each group that aren't stop words; ties by name. words: group, word."""
    counts = words.filter(~F.col("word").isin(list(stop_words))).groupBy(group, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))
    return counts.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def keyword_scores(text: Column, groups: Mapping[str, Mapping[str, tuple[Sequence[str], float]]], counted: Mapping[str, Sequence[str]], own: Sequence[str], either: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A struct of what a text says of several subjects besides its own. For each group n_{group} (how many of the keywords counted for it
    occur as substrings of the lower-case text), density_{group} (the same for each 100 words), is_{flag} (one of the flag's keywords occurs) and
    score_{group} (the weights of its flags that are set); any_{name} (one of several flags is set); score, over all groups; and own_share: the own
    keywords that occur, as a share of them and all counted ones. A null text, one without words: 0 everywhere, own_share 0.5; so
    is own_share where nothing occurs."""
    held = lambda t, words: F.size(F.filter(F.array(*[F.lit(w.lower()) for w in dict.fromkeys(words)]), lambda w: F.contains(t, w))) if words else F.lit(0)
    any_of = lambda t, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(t, w)).cast("int")

    def found(t: Column) -> Column:
        counts = [held(t, counted.get(g, ())).alias(f"n_{g}") for g in groups]
        flags = [any_of(t, words).alias(f"is_{name}") for flags in groups.values() for name, (words, _) in flags.items()]
        return F.struct(*counts, *flags, held(t, own).alias("_own"), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).alias("_words"))

    def scored(x: Column) -> Column:
        full = x["_words"] > 0
        only = lambda c: F.when(full, c).otherwise(F.lit(0))
        scores = {g: sum((only(x[f"is_{name}"]) * F.lit(float(weight)) for name, (_, weight) in flags.items()), F.lit(0.0)) for g, flags in groups.items()}
        total = sum((x[f"n_{g}"] for g in groups), F.lit(0)) + x["_own"]
        out = []
        for g, flags in groups.items():
            out += [only(x[f"n_{g}"]).alias(f"n_{g}"), F.when(full, 100.0 * x[f"n_{g}"] / x["_words"]).otherwise(F.lit(0.0)).alias(f"density_{g}")]
            out += [only(x[f"is_{name}"]).alias(f"is_{name}") for name in flags] + [scores[g].alias(f"score_{g}")]
        out += [only(F.greatest(F.lit(0), *[x[f"is_{n}"] for n in names])).alias(f"any_{k}") for k, names in (either or {}).items()]
        share = F.when(full & (total > 0), x["_own"] / total).otherwise(F.lit(0.5))
        return F.struct(*out, sum(scores.values(), F.lit(0.0)).alias("score"), share.alias("own_share"))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), found), scored)


def publisher_block(source: Column, categories: Column, publishers: Mapping[str, Sequence[str]], flags: Mapping[str, str], counted: Mapping[str, Sequence[str]], scores: Sequence[tuple[str, float]], default: float = 0.35) -> dict[str, Column]:
    """from_{list} where the source's name holds a publisher of the list, has_{flag} where the category is among the article's, n_{list}: how many of its categories
    (repeated ones each) are in the list, and reputation: the score of the first domain that the source's name holds. Nulls count as nothing."""
    lowered = F.lower(F.coalesce(source, F.lit("")))
    names = F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(c))
    out = {f"from_{k}": F.exists(F.array(*[F.lit(p.lower()) for p in v]), lambda p: F.contains(lowered, p)).cast("int") for k, v in publishers.items()}
    out |= {f"has_{k}": F.coalesce(F.array_contains(names, c.lower()), F.lit(False)).cast("int") for k, c in flags.items()}
    among = lambda v: lambda c: c.isin([x.lower() for x in v])
    out |= {f"n_{k}": F.size(F.filter(names, among(v))) for k, v in counted.items()}
    return out | {"reputation": source_reputation(lowered, [(d.lower(), s) for d, s in scores], default)}


def window_terms(docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[str], reach: int = 20, pattern: str = r"[a-z]{2,}", **options) -> DataFrame:
    """(id, term, weight) as ``weighted_terms`` weighs, of the words that stand around the phrases alone (window after window, overlaps count
    again). Documents without a phrase have no terms, but count among all documents."""
    from ..functions.text import windows_around

    return weighted_terms(docs, id_col, F.regexp_extract_all(windows_around(F.col(text_col), phrases, reach), F.lit(pattern), F.lit(0)), **options)
