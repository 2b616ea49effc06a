"""URL filters (operator 3): rules, and logistic regression on hashed character n-grams. DataFrame functions only.

A url's host and path are cut out; a rule ``host/path`` fits its host and all subdomains if the url's path begins with
the rule's path; the longest fitting rule decides. Other urls are judged by a logistic regression on the character
n-grams (``sizes``) of ``^host$`` and ``^path$``, hashed into ``features`` buckets, trained on a small labelled table: url and
label 1 (block) or 0 (allow). ``labelled_by_rules`` makes such a table from urls that rules decide, with its size bounded.

Sizes: rules and weights are bounded by their parameters, not by the corpus, and reach the expressions as literals.

Defined results: a null url, and one without ``://``, has an empty host and path, fits no rule and is judged by the
regression on nothing but the two markers; of rules of equal length (such as the same one twice) the later given one decides; a very
long url is judged whole, by as many n-grams as it has; repeated rows are judged each; with no label of one kind every verdict is the
other kind, without labels ``allow``; empty tables give empty tables; further columns pass through, those of the result's
names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, dropped, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """urls with host, path, rule and rule_verdict (null where none fits). rules: ('allow' or 'block', 'host/path')."""
    out = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        host, _, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumns({"rule": found, "rule_verdict": verdict})


def grams(host: Column, path: Column, sizes: Sequence[int]) -> Column:
    """The distinct character n-grams of the marked host and path."""

    def of(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    parts = [F.concat(F.lit("h^"), host, F.lit("$")), F.concat(F.lit("p^"), path, F.lit("$"))]
    return F.array_distinct(F.concat(*[of(p, n) for p in parts for n in sizes]))


def labelled_by_rules(judged: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """The rows that rules decide, with label: about max_rows at most, picked by a hash of the id."""
    known = judged.filter(F.col("rule_verdict").isNotNull())
    return bounded_sample(known.withColumn("label", (F.col("rule_verdict") == "block").cast("double")), id_col, max_rows)


def filtered(urls: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", sizes: Sequence[int] = (2, 3, 4), features: int = 1 << 14, max_rows: int = 20_000, ridge: float = 0.01) -> DataFrame:
    """urls with host, path, rule, block_probability (of the regression) and verdict. labelled: host, path and label, a small table;
    by default, what the rules say of a bounded sample of the urls: where nobody has labelled urls, the rules are the only
    judgement there is, and the regression carries it over to urls that look like those they decide.

    Hosts, rules and n-grams are computed once and stored; fitting and scoring read them from there."""
    hashing = HashingTF(numFeatures=features, binary=True, inputCol="_grams", outputCol="_features")
    hashed = lambda parts: hashing.transform(parts.withColumn("_grams", grams(F.col("host"), F.col("path"), sizes))).drop("_grams")
    judged = stored(hashed(with_rule(urls, rules, url_col)), "urls")
    if labelled is None:
        table = labelled_by_rules(judged, id_col, max_rows)
    else:
        table = hashed(labelled.filter("label is not null").select("label", "host", "path"))
    train = stored(table.select("_features", F.col("label").cast("double").alias("label")), "labelled")
    kinds = {r["label"] for r in train.select("label").distinct().collect()}
    if len(kinds) < 2:
        scored = judged.withColumn("block_probability", F.lit(float(max(kinds, default=0.0))))
    else:
        model = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", regParam=ridge, maxIter=50).fit(train)
        scored = model.transform(judged).withColumn("block_probability", vector_to_array("_p")[1]).drop("_p", "_raw", "_y")
    dropped(train)
    own = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict", "_features")
