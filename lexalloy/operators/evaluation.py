"""Scores against labels, thresholds, splits, drift, and the model registry: aggregates, and running sums over ranges of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, value: str, sums: Sequence[str], falling: bool = False, parts: int = 64, group: str | None = None) -> DataFrame:
    """df (one row a value and group) with ``{c}_upto``, the sum of c over all rows up to the row's value, and ``{c}_all``.

    Values are cut at quantiles into about ``parts`` ranges; each range is summed up by a window of its own, and what lies
    before a range comes from the ranges' totals, of which there are few. So no task sees all values."""
    keys = [group] if group else []
    bounds = sorted(set(df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.01)))
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value))) if bounds else F.lit(0))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    order = lambda c: F.desc(c) if falling else F.asc(c)
    before = Window.partitionBy(*keys).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(totals, [*keys, "_range"])
    return out.withColumns({f"{c}_upto": F.col(f"_{c}_before") + F.sum(c).over(inside) for c in sums}).drop("_range", *[f"_{c}_before" for c in sums])


def stratified(df: DataFrame, label: str, key: str, shares: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """df with split (0, 1, ...): in each class, rows in the order of a hash of the key are dealt by the shares. A row's place
    is the number of rows in lower ranges of the hash (4,096 a class) and its place in its own range."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key).cast("string"), F.lit(seed))).withColumn("_range", F.shiftright("_hash", 52))
    counts = hashed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_label"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    placed = hashed.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))  # 4,096 rows a class
    place = (F.col("_before") + F.row_number().over(Window.partitionBy(label, "_range").orderBy("_hash", key)) - 1) / F.col("_all")
    split, total = F.lit(len(shares) - 1), 1.0
    for i in range(len(shares) - 2, -1, -1):
        total -= shares[i + 1]
        split = F.when(F.col("_place") < total - 1e-12, F.lit(i)).otherwise(split)
    return placed.withColumn("_place", place).withColumn("split", split).select(*df.columns, "split")


def curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """For each distinct score, falling: tp and fp at or above it, and the totals. Counts are summed first."""
    distinct = scored.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    found = running(distinct, "score", ("p", "n"), falling=True)
    return found.select("score", "p", "n", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), F.col("p_all").alias("positives"), F.col("n_all").alias("negatives"))


def metrics(scored: DataFrame, score: str, label: str, threshold: float, beta: float = 2.0) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1, F-beta, ROC area (ties count half), average precision."""
    y, p = F.col(label).cast("boolean"), F.col(score) >= threshold
    counts = scored.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    c = curve(scored, score, label)
    area = c.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("roc_auc"), F.sum(F.col("p") / F.nullif(F.col("positives"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    f = lambda b: F.try_divide((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    return counts.crossJoin(area).withColumns({"accuracy": F.try_divide(tp + F.col("tn"), tp + fp + fn + F.col("tn")), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": f(1.0), "f_beta": f(beta)})


def recall_thresholds(scored: DataFrame, score: str, label: str, targets: Sequence[float] = (0.90, 0.95, 0.97, 0.98, 0.99)) -> DataFrame:
    """target, threshold: the largest score at which recall reaches the target."""
    asked = F.array(*[F.lit(float(t)) for t in targets])
    reached = curve(scored, score, label).select("score", F.explode(F.filter(asked, lambda t: F.col("tp") >= t * F.col("positives"))).alias("target"))
    return reached.groupBy("target").agg(F.max("score").alias("threshold"))


def ks_drift(reference: DataFrame, current: DataFrame, column: str, decision: str | None = None, limit: float = 0.1) -> DataFrame:
    """One row: two-sample Kolmogorov-Smirnov statistic, asymptotic p-value, difference of the mean decisions, score, drifted."""
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(column).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter("v is not null")
    sums = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = running(sums, "v", ("a", "b"))
    shares = counted.select(F.try_divide("a_upto", "a_all").alias("fa"), F.try_divide("b_upto", "b_all").alias("fb"), F.col("a_all").alias("n"), F.col("b_all").alias("m"))
    found = shares.agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    scale = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("statistic")
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * scale * scale) for k in range(1, 31)), F.lit(0.0))
    found = found.withColumn("p_value", F.when(scale < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0))))
    shift: Column = F.lit(0.0)
    if decision is not None:
        mean = lambda df, name: df.agg(F.avg(F.col(decision).cast("double")).alias(name))
        found = found.crossJoin(mean(reference, "_r")).crossJoin(mean(current, "_c"))
        shift = F.abs(F.coalesce(F.col("_c") - F.col("_r"), F.lit(0.0)))
    found = found.withColumn("shift", shift).withColumn("score", F.coalesce(F.greatest("statistic", "shift"), F.lit(0.0)))
    return found.withColumn("drifted", F.col("score") > limit).drop("_r", "_c")


def halves(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The earlier and the later half by the quantile of the order column: what drift is measured on without a reference set."""
    middle = rows.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [0.5], 0.001)
    bound = middle[0] if middle else 0.0
    early = F.col(order).cast("double") < bound
    return rows.filter(early), rows.filter(~early)


def latest_version(registry: DataFrame, version: Column) -> DataFrame:
    """The row of each model's largest version (an array of numbers)."""
    return registry.groupBy("model").agg(F.max_by(F.struct("*"), version).alias("row")).select("row.*")


def promotion(new: float, production: float | None, margin: float = 0.01) -> tuple[bool, bool]:
    """Whether a new model may be promoted, and whether it is significantly better."""
    return (True, True) if production is None else (new >= production, new > production + margin)


def pivoted(results: DataFrame, index: str, column: str, names: Sequence[str], values: Sequence[str], order: Column) -> DataFrame:
    """A row an index value with ``{value}_{name}`` for each name that the column may have: the value in the first such row by ``order``, null without
    one. The names are given, so that the result's columns don't depend on the rows and nothing is read beforehand."""
    first = [F.min_by(F.when(F.col(column) == n, F.col(v)), F.when(F.col(column) == n, order)).alias(f"{v}_{n}") for v in values for n in names]
    return results.groupBy(index).agg(*first)


def validated(scored: DataFrame, probability: str = "probability", threshold: float = 0.5, label: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """How a served model does on rows that it has scored, in all or by group: n_samples, threshold, n_positive (at the threshold), n_invalid (null,
    NaN or outside [0, 1]), success (rows, none invalid), accuracy (null unless every row has a label)."""
    p = F.col(probability).cast("double")
    decided = (p >= threshold).cast("int")
    valid = F.coalesce(p.between(0, 1) & ~F.isnan(p), F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    right = F.lit(None).cast("double") if label is None else F.when((F.count("*") > 0) & (F.count(F.col(label)) == F.count("*")), F.avg(F.coalesce(decided == F.col(label), F.lit(False)).cast("double")))
    parts = [F.count("*").alias("n_samples"), F.lit(float(threshold)).alias("threshold"), count(F.coalesce(decided, F.lit(0))).alias("n_positive"), count(~valid).alias("n_invalid"), ((F.count("*") > 0) & (count(~valid) == 0)).alias("success"), right.alias("accuracy")]
    return scored.groupBy(*by).agg(*parts) if by else scored.agg(*parts)
