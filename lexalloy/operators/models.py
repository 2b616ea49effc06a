"""Classifiers over feature vectors with pyspark.ml: estimators, cross-validated grids with several measures, comparison,
gaps between training and validation, calibration, scoring, importance of feature groups.

Runs over parameters are independent Spark jobs driven by a loop over the grid (as ``CrossValidator`` does); data stay on
the executors, only measures (a row a fit) come to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import stored
from .evaluation import metrics

ESTIMATORS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "svm": LinearSVC, "boosting": GBTClassifier}
MEASURES = ("accuracy", "precision", "recall", "f1", "f_beta", "average_precision")


@dataclass(frozen=True)
class Config:
    """What a classifier is: an estimator's name, its parameters, the decision threshold."""

    estimator: str = "logistic"
    params: tuple[tuple[str, object], ...] = ()
    threshold: float = 0.5
    label: str = "label"
    features: str = "features"
    balanced: bool = True


@dataclass(frozen=True)
class Scorer:
    """A fitted model; ``score`` adds probability and predicted."""

    config: Config
    model: object
    slope: float | None = None
    offset: float = 0.0

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows)
        if self.slope is None:
            p = vector_to_array("probability")[1]
        else:
            p = 1 / (1 + F.exp(-(self.slope * vector_to_array("rawPrediction")[1] + self.offset)))
        out = out.withColumn("_p", p).drop("probability", "rawPrediction", "prediction").withColumnRenamed("_p", "probability")
        return out.withColumn("predicted", (F.col("probability") >= self.config.threshold).cast("int"))

    def info(self) -> dict[str, object]:
        return {"estimator": self.config.estimator, "threshold": self.config.threshold, "calibrated": self.slope is not None, **dict(self.config.params)}


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: each class weighs the same in all."""
    n = Window.partitionBy()
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).select(label, "_n", F.sum("_n").over(n).alias("_all"), F.count("*").over(n).alias("_classes"))
    return rows.join(F.broadcast(counts), label).withColumn("weight", F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def fitted(rows: DataFrame, config: Config) -> Scorer:
    """The model of a config; a support vector machine's raw value is calibrated by a logistic regression on it."""
    data = weighted(rows, config.label) if config.balanced else rows
    options = {"featuresCol": config.features, "labelCol": config.label, **dict(config.params)} | ({"weightCol": "weight"} if config.balanced else {})
    model = ESTIMATORS[config.estimator](**options).fit(data)
    if config.estimator != "svm":
        return Scorer(config, model)
    raw = model.transform(data).select(F.col(config.label).cast("double").alias("label"), array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
    sigmoid = LogisticRegression().fit(raw)
    return Scorer(config, model, float(sigmoid.coefficients[0]), float(sigmoid.intercept))


def measured(rows: DataFrame, scorer: Scorer) -> dict[str, float]:
    row = metrics(scorer.score(rows), "probability", scorer.config.label, scorer.config.threshold).first()
    return {m: row[m] for m in (*MEASURES, "roc_auc")}


def searched(rows: DataFrame, base: Config, grid: Mapping[str, Sequence[object]], folds: int = 3, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """A row for each parameter set, fold and part (train, test) with all measures."""
    spark, made = rows.sparkSession, []
    dealt = stored(rows, "grid_rows").withColumn("_fold", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(folds)))
    for number, values in enumerate(product(*grid.values())):
        config = Config(base.estimator, (*base.params, *zip(grid, values, strict=True)), base.threshold, base.label, base.features, base.balanced)
        for fold in range(folds):
            scorer = fitted(dealt.filter(F.col("_fold") != fold), config)
            for part, test in (("train", F.col("_fold") != fold), ("test", F.col("_fold") == fold)):
                found = measured(dealt.filter(test), scorer)
                made.append((number, base.estimator, str(dict(config.params)), fold, part, *[None if found[m] is None else float(found[m]) for m in (*MEASURES, "roc_auc")]))
    return spark.createDataFrame(made, "run int, estimator string, params string, fold int, part string, " + ", ".join(f"{m} double" for m in (*MEASURES, "roc_auc")))


def summarised(fits: DataFrame, measure: str = "f_beta") -> DataFrame:
    """Mean and (population) deviation over folds of a measure by run, for both parts, their gap, and its verdict."""
    by_run = fits.groupBy("run", "estimator", "params").agg(*[f(F.when(F.col("part") == p, F.col(measure))).alias(f"{n}_{p}") for p in ("train", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return with_gap(by_run).withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_test"))))  # a row a run


def with_gap(runs: DataFrame, train: str = "mean_train", test: str = "mean_test") -> DataFrame:
    """runs with gap and verdict: severe from 0.10 on, moderate from 0.05 on, else good."""
    gap = F.col(train) - F.col(test)
    advice = F.when(gap >= 0.10, F.lit("regularise more, simplify the model or add data")).when(gap >= 0.05, F.lit("watch it, regularise a little more")).otherwise(F.lit("none needed"))
    return runs.withColumns({"gap": gap, "verdict": F.when(gap >= 0.10, F.lit("severe")).when(gap >= 0.05, F.lit("moderate")).otherwise(F.lit("good")), "advice": advice})


def parameter_curve(fits: DataFrame, parameter: str, measure: str = "f_beta", by: Sequence[str] = ()) -> DataFrame:
    """By value of a parameter (a column of fits: a row a value, fold and part): mean and (population) deviation of a measure over folds for both
    parts, their gap and verdict, gain (what the test mean adds to that of the next lower value), is_best (largest test mean to twelve digits, the lowest value
    of several), and past_best (a higher value than the best one). Measures of no row are null and never best. A row a value: windows are as small as
    the parameter's range."""
    of = lambda p, f: f(F.when(F.col("part") == p, F.col(measure)))
    curve = fits.groupBy(*by, parameter).agg(*[of(p, f).alias(f"{n}_{p}") for p in ("train", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rising = Window.partitionBy(*by).orderBy(parameter)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("mean_test", 12).desc_nulls_last(), parameter))
    marked = with_gap(curve).withColumns({"gain": F.col("mean_test") - F.lag("mean_test").over(rising), "is_best": (place == 1) & F.col("mean_test").isNotNull()})
    return marked.withColumn("past_best", F.coalesce(F.max("is_best").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))


def top_runs(summaries: DataFrame, n: int = 10, measure: str = "mean_test") -> DataFrame:
    """The n best runs by a measure, ties by run (a top-k report)."""
    return summaries.orderBy(F.desc_nulls_last(measure), "run").limit(n)


def gap_summary(summaries: DataFrame, by: str = "estimator", measure: str = "mean_test") -> DataFrame:
    """The best run of each estimator with the gap as a share of its training mean, and a verdict on that share (severe from 0.10 on, moderate
    from 0.05 on). Estimators whose runs have no measure are left out."""
    row = summaries.filter(F.col(measure).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*[c for c in summaries.columns if c != by]), F.struct(measure, -F.col("run"))).alias("r")).select(by, "r.*")
    share = F.when(F.col("mean_train") > 0, (F.col("mean_train") - F.col("mean_test")) / F.col("mean_train")).otherwise(F.lit(0.0))
    return row.withColumn("gap_share", share).withColumn("verdict", F.when(share >= 0.10, F.lit("severe")).when(share >= 0.05, F.lit("moderate")).otherwise(F.lit("good")))


def advised(runs: DataFrame, advice: Mapping[tuple[str, str], str], by: str = "estimator", default: str | None = None) -> DataFrame:
    """runs with advice: what the table says for a run's estimator and verdict, else the default. Who uses it knows the estimators and words the advice."""
    text = F.lit(default).cast("string")
    for (estimator, verdict), words in advice.items():
        text = F.when((F.col(by) == estimator) & (F.col("verdict") == verdict), F.lit(words)).otherwise(text)
    return runs.withColumn("advice", text)


def best(summaries: DataFrame, measure: str = "mean_test") -> DataFrame:
    """The one row with the largest measure; ties go to the first run."""
    return summaries.agg(F.max_by(F.struct("*"), F.struct(measure, -F.col("run"))).alias("r")).select("r.*")


def compared(rows: DataFrame, configs: Mapping[str, Config], folds: int = 3, id_col: str = "doc_id") -> DataFrame:
    """A row a named config: the mean of each measure over test folds."""
    parts = [searched(rows, c, {}, folds, id_col).filter("part = 'test'").agg(*[F.avg(m).alias(m) for m in (*MEASURES, "roc_auc")]).select(F.lit(n).alias("name"), "*") for n, c in configs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shifted(validation: Mapping[str, float], test: Mapping[str, float], spark: SparkSession) -> DataFrame:
    """By measure: both values, their difference, the change in percent, and whether it fell by more than 0.05."""
    rows = [(m, float(validation[m]), float(test[m])) for m in validation if test.get(m) is not None and validation[m] is not None]
    out = spark.createDataFrame(rows, "measure string, validation double, test double").withColumn("difference", F.col("test") - F.col("validation"))
    return out.withColumns({"change_pct": F.try_divide(100 * F.col("difference"), F.col("validation")), "warning": F.col("difference") < -0.05})


def group_importance(values: DataFrame, groups: Mapping[str, tuple[int, int]], column: str = "values") -> DataFrame:
    """Mean absolute value a row of each range of places of an array column, its share of all, and rank."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.aggregate(F.slice(column, a + 1, b - a), F.lit(0.0), lambda s, x: s + F.abs(x)).alias("v")) for n, (a, b) in groups.items()])
    sums = values.select(F.inline(parts)).groupBy("name").agg(F.avg("v").alias("importance"))
    every = Window.partitionBy()  # a row a group
    return sums.withColumns({"share": F.try_divide(F.col("importance"), F.sum("importance").over(every)), "rank": F.rank().over(Window.orderBy(F.desc("importance")))})


def permutation_importance(rows: DataFrame, scorer: Scorer, groups: Mapping[str, tuple[int, int]], measure: str = "average_precision", seed: int = 7) -> DataFrame:
    """How much a measure falls when a group's features are those of another row. Rows are paired with the next one in the order of a
    hash within hash ranges, so no task sees all rows."""
    config, base = scorer.config, measured(rows, scorer)[measure]
    hashed = rows.withColumn("_h", F.xxhash64(config.features, F.lit(seed))).withColumn("_r", F.pmod("_h", F.lit(256)))
    other = hashed.withColumn("_other", F.coalesce(F.lead(config.features).over(Window.partitionBy("_r").orderBy("_h")), F.col(config.features)))
    out = []
    for name, (a, b) in groups.items():
        mixed = F.transform(vector_to_array(config.features), lambda x, i: F.when((i >= a) & (i < b), F.get(vector_to_array("_other"), i)).otherwise(x))
        found = measured(other.withColumn(config.features, array_to_vector(mixed)).drop("_other", "_h", "_r"), scorer)[measure]
        out.append((name, float(base - found)))
    return rows.sparkSession.createDataFrame(out, "name string, importance double").orderBy(F.desc("importance"))


def top_terms(weights: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """The n heaviest terms of each document, by weight and then by name."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "term"))
    return weights.withColumn("place", place).filter(F.col("place") <= n)


def truncated(text: Column, most: int = 20_000) -> Column:
    """A text as a model is served it: at most ``most`` characters, back to the last space."""
    from ..functions.text import cut_at

    return cut_at(F.coalesce(text, F.lit("")), most, " ")
