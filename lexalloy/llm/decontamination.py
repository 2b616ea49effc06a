"""Benchmark decontamination (operator 4): a distributed positional inverted index. DataFrame functions only.

``build_index`` stores, for each document row, the postings of the words that occur in the test items: two parallel
arrays, the word's 64-bit hash and its position, in the order of the text. Each row is a shard of its own, so building
and searching need no shuffle of postings, whatever the sizes of the documents or the frequency of a word.

``matches`` ranks the words of every test phrase by their corpus frequency (counted over the whole index), takes the
postings of the two rarest ones as candidate beginnings (position minus offset), intersects the two lists, and checks
what is left against the offset-adjusted postings of all other words: the exact occurrences.
``proximity`` gives places where the rarest words of an item stand within a span of positions, in any order.

Sizes: the test items' words reach the expressions as a literal set only while there are at most ``max_literals`` of
them; beyond, every word of the corpus is indexed. Phrases (and their items) are broadcast only while there are at most
``max_broadcast`` of them; beyond, postings and phrases meet in a shuffle by word, in which common words are salted.
Results are the same either way.

Defined results: a null text has no words, is clean and has empty lists; an item without words matches nothing; an item
that occurs in several rows is listed once; an item without an id counts as a hit and is listed nowhere; repeated document rows are judged each; empty tables give empty tables or
clean documents; further columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Fixed: what isn't part of a word. (ASCII letters are lower-cased first.)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def phrases(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """phrase (hashes of consecutive words of an item; all of them, for an item under window words), items that have it."""
    words = items.select(F.col(id_col).alias("item_id"), hashes_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    slices = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("phrase"))
    return slices.groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", max_literals: int = 50_000) -> DataFrame:
    """The stored index: row (unique), doc_id, n_words, word (hashes), at (their positions, ascending)."""
    vocabulary = items.select(F.explode(hashes_of(F.col(item_text_col))).alias("w")).distinct().limit(max_literals + 1).collect()
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), hashes_of(F.col(text_col)).alias("all"))
    if len(vocabulary) > max_literals:
        kept = hashed.withColumns({"word": F.col("all"), "at": F.when(F.size("all") > 0, F.sequence(F.lit(0), F.size("all") - 1)).otherwise(F.array().cast("array<int>"))})
    else:
        known = [r.w for r in vocabulary]
        at = F.filter(F.transform("all", lambda w, i: F.when(w.isin(known), i)), lambda i: i.isNotNull())
        kept = hashed.withColumn("at", at).withColumn("word", F.filter("all", lambda w: w.isin(known)))
    return stored(kept.select("row", "doc_id", F.size("all").cast("long").alias("n_words"), "word", "at"), "postings")


def frequencies(index: DataFrame) -> DataFrame:
    """w, n: occurrences of each indexed word in the corpus."""
    return index.select(F.explode("word").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def ranked(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """patterns with order: (n, offset) of the phrase's words from the rarest to the commonest in the corpus. A pattern with an unseen word can't occur and goes. counts: ``frequencies``."""
    offsets = patterns.select("phrase", "items", F.posexplode("phrase").alias("offset", "w"))
    counted = offsets.join(counts, "w")
    ordered = counted.groupBy("phrase", "items").agg(F.sort_array(F.collect_list(F.struct("n", "offset"))).alias("order"))
    return ordered.filter(F.size("order") == F.size("phrase")).select("phrase", "items", "order")


def sought(postings: DataFrame, lists: DataFrame, total: int, salt_rows: int) -> DataFrame:
    """postings joined with lists by word through a shuffle, in which no word keeps more than about ``salt_rows`` postings
    together: a commoner word's are dealt over salts, its lists repeated for each. At most 10,000 words are that common
    (their number is broadcast). lists: word, n (the word's postings)."""
    most = max(salt_rows, total // 10_000)
    common = lists.filter(F.col("n") > most).select("word", F.ceil(F.col("n") / most).cast("int").alias("salts")).distinct()
    dealt = postings.join(F.broadcast(common), "word", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row", "at"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    salts = F.sequence(F.lit(0), F.when(F.col("n") > most, F.ceil(F.col("n") / most).cast("int") - 1).otherwise(0))
    return dealt.join(lists.withColumn("salt", F.explode(salts)), ["word", "salt"]).drop("salt", "n")


def matches(index: DataFrame, patterns: DataFrame, max_broadcast: int = 100_000, salt_rows: int = 1_000_000) -> DataFrame:
    """row, doc_id, n_words; hits, the exact occurrences of phrases: array of (start, length), ascending; items, the distinct
    items that have them, ascending. Both are empty where there are none."""
    counts = frequencies(index)
    plan = stored(ranked(patterns, counts).withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    few = plan.count() <= max_broadcast
    hinted = F.broadcast if few else (lambda df: df)
    lists = plan.select("phrase_id", F.least(F.size("order"), F.lit(2)).alias("lists"), "phrase", F.explode(F.slice("order", 1, 2)).alias("o"))
    lists = lists.select("phrase_id", "lists", F.col("o.offset").alias("offset"), F.element_at("phrase", F.col("o.offset") + 1).alias("word"), F.col("o.n").alias("n"))
    postings = index.select("row", F.posexplode(F.arrays_zip("word", "at")).alias("i", "p")).select("row", "i", "p.word", "p.at")
    if few:
        found = postings.join(F.broadcast(lists), "word")
    else:
        found = sought(postings, lists, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], salt_rows)
    # all words of an occurrence are indexed, so its first one is as many postings back as it is words back
    starts = found.select("row", "phrase_id", "lists", (F.col("at") - F.col("offset")).alias("start"), (F.col("i") - F.col("offset")).alias("i")).filter("i >= 0")
    both = starts.groupBy("row", "phrase_id", "start", "i", "lists").agg(F.count("*").alias("n")).filter("n = lists")
    candidates = both.join(hinted(plan.select("phrase_id", "phrase")), "phrase_id").groupBy("row").agg(F.collect_list(F.struct("start", "i", "phrase", "phrase_id")).alias("candidates"))

    def occurs(c: Column) -> Column:
        """The words indexed from place c.i on are those of the phrase, and stand side by side from c.start on."""
        size = F.size(c.phrase)
        return (F.slice("word", c.i + 1, size) == c.phrase) & (F.get("at", c.i) == c.start) & (F.get("at", c.i + size - 1) == c.start + size - 1)

    hits = F.transform(F.filter("candidates", occurs), lambda c: F.struct(c.start.alias("start"), F.size(c.phrase).alias("length"), c.phrase_id.alias("phrase_id")))
    exact = stored(index.join(candidates, "row").select("row", hits.alias("hits")).filter(F.size("hits") > 0), "hits")
    # a phrase's items are joined once a document that has it, not once an occurrence
    held = exact.select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h.phrase_id))).alias("phrase_id"))
    of_phrase = plan.select("phrase_id", F.explode("items").alias("item_id"))
    items = held.join(hinted(of_phrase) if few and of_phrase.count() <= max_broadcast else of_phrase, "phrase_id").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    spans = exact.select("row", F.sort_array(F.transform("hits", lambda h: F.struct(h.start.alias("start"), h.length.alias("length")))).alias("hits"))
    kind = patterns.schema["items"].dataType.simpleString()
    found = index.select("row", "doc_id", "n_words").join(spans.join(items, "row", "left"), "row", "left")
    return found.select("row", "doc_id", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"), F.coalesce("items", F.array().cast(kind)).alias("items"))


def proximity(index: DataFrame, items: DataFrame, rarest: int = 3, span: int = 26, id_col: str = "item_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """row, doc_id, item_id, position: an occurrence of an item's rarest word with its next rarest ones (``rarest`` in all) at most span positions away,
    in any order. Only places of rare words leave their documents; each looks at the postings around it, of which span bounds the number."""
    words = items.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(hashes_of(F.col(text_col)))).alias("w")).join(frequencies(index), "w")
    rare = words.groupBy("item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "w"))), 1, rarest).alias("o"))
    rare = stored(rare.select("item_id", F.col("o")[0].w.alias("word"), F.transform(F.expr("slice(o, 2, size(o))"), lambda x: x.w).alias("others")), "rare_words")
    places = index.select("row", F.posexplode("word").alias("i", "word"))
    here = places.join(F.broadcast(rare) if rare.count() <= max_broadcast else rare, "word").groupBy("row").agg(F.collect_list(F.struct("i", "item_id", "others")).alias("candidates"))

    def close(c: Column) -> Column:
        at = F.get("at", c.i)
        around = F.slice("postings", F.greatest(c.i - span, F.lit(0)) + 1, F.lit(2 * span + 1))
        near = F.transform(F.filter(around, lambda p: F.abs(p.at - at) <= span), lambda p: p.word)
        return F.size(F.array_except(c.others, near)) == 0

    found = index.join(here, "row").withColumn("postings", F.arrays_zip("word", "at"))
    kept = found.select("row", "doc_id", "at", F.explode(F.filter("candidates", close)).alias("c"))
    return kept.select("row", "doc_id", F.col("c.item_id").alias("item_id"), F.get("at", F.col("c.i")).alias("position"))


def covered(intervals: Column) -> Column:
    """How many positions an ascending array of (start, length) covers."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(intervals, zero, lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.start + x.length - F.greatest(s.end, x.start))).alias("n"), F.greatest(s.end, x.start + x.length).alias("end")), lambda s: s.n)


def judged(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: row, doc_id, n_words, n_hit (words inside occurrences), items (ids of occurring items, sorted), contaminated (a hit, and at least one word in ``one_in``)."""
    found = matches(build_index(docs, items, id_col, text_col), phrases(items, window))
    out = found.select("row", "doc_id", "n_words", covered(F.col("hits")).cast("long").alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))
