"""Training as one call, without leaks: what a feature method learns (vocabulary, frequencies, latent components, scales) it learns
from a fold's training rows alone, once a fold, and all classifiers of that fold share the stored result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored
from . import latent as factors
from . import registry
from .evaluation import recall_thresholds, stratified
from .models import MEASURES, Config, Scorer, fitted, measured


@dataclass(frozen=True)
class Method:
    """A feature method: weighted terms (words, or sequences of ``grams`` words) of a text, as they are or as ``components`` latent ones, beside scaled numbers."""

    text: str | None = "text"
    grams: int = 1
    max_features: int = 10_000
    min_df: float = 2.0
    max_df: float = 0.95
    components: int = 0
    numbers: tuple[str, ...] = ()


#: Names that a configuration may give a feature method, and what they mean.
KINDS = {"words": {}, "word_pairs": {"grams": 2}, "latent": {"components": 100}, "numbers": {"text": None}}
_OPTIONS = {"text": str, "grams": int, "max_features": int, "min_df": float, "max_df": float, "components": int, "numbers": tuple}


def method_from(config: Mapping[str, object]) -> Method:
    """A feature method from a configuration (such as a JSON sidecar): ``method``, one of KINDS, and any of a method's own settings, which win over
    what the kind sets. An unknown kind, setting or a value that doesn't fit is an error that names it, not ignored."""
    kind = config.get("method", "words")
    if kind not in KINDS:
        raise ValueError(f"unknown feature method: {kind!r}")
    settings = dict(KINDS[kind])
    for name, value in config.items():
        if name == "method":
            continue
        if name not in _OPTIONS:
            raise ValueError(f"unknown setting of a feature method: {name!r}")
        try:
            settings[name] = None if name == "text" and value is None else _OPTIONS[name](value)
        except (TypeError, ValueError) as error:
            raise ValueError(f"{name!r} can't be {value!r}") from error
    made = Method(**settings)
    if made.text is None and not made.numbers:
        raise ValueError("a feature method needs a text or numbers")
    return made


@dataclass(frozen=True)
class Fitted:
    """What a method has learned; ``apply`` adds features."""

    method: Method
    terms: PipelineModel | None
    components: factors.Latent | None
    scaler: PipelineModel | None

    def apply(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = _plain(rows, self.method)
        parts = []
        if self.terms is not None:
            out = self.terms.transform(out)
            if self.components is not None:
                out = self.components.apply(out, "_terms", "_latent").withColumn("_latent", array_to_vector("_latent"))
                out = VectorSizeHint(inputCol="_latent", size=len(self.components.values), handleInvalid="optimistic").transform(out)
            parts.append("_terms" if self.components is None else "_latent")
        if self.scaler is not None:
            out = self.scaler.transform(out)
            parts.append("_scaled")
        made = VectorAssembler(inputCols=parts, outputCol="features").transform(out.drop("features"))
        return made.drop("_text", "_words", "_grams", "_counts", "_weights", "_terms", "_latent", "_numbers", "_scaled", *[f"_n_{c}" for c in self.method.numbers])


def _plain(rows: DataFrame, method: Method) -> DataFrame:
    out = rows if method.text is None else rows.withColumn("_text", F.coalesce(F.col(method.text), F.lit("")))
    return out.withColumns({f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in method.numbers})


def learned(rows: DataFrame, method: Method) -> Fitted:
    """The method, fitted on rows."""
    plain = _plain(rows, method)
    terms = components = scaler = None
    if method.text is not None:
        stages = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{Nd}_]+", gaps=False)]
        if method.grams > 1:
            stages.append(NGram(n=method.grams, inputCol="_words", outputCol="_grams"))
        counts = CountVectorizer(inputCol="_grams" if method.grams > 1 else "_words", outputCol="_counts", vocabSize=method.max_features, minDF=method.min_df, maxDF=method.max_df)
        terms = Pipeline(stages=[*stages, counts, IDF(inputCol="_counts", outputCol="_weights"), Normalizer(inputCol="_weights", outputCol="_terms")]).fit(plain)
        if method.components:
            components = factors.factorised(terms.transform(plain).select("_terms"), method.components, "_terms")
    if method.numbers:
        scaler = Pipeline(stages=[VectorAssembler(inputCols=[f"_n_{c}" for c in method.numbers], outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]).fit(plain)
    return Fitted(method, terms, components, scaler)


def crossed(rows: DataFrame, methods: Mapping[str, Method], classifiers: Mapping[str, Config], folds: int = 3, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """A row a feature method, classifier, fold and part (train, test) with all measures. Features are made once a method and fold."""
    dealt = stored(rows.withColumn("_fold", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(folds))), "dealt")
    made = []
    for name, method in methods.items():
        for fold in range(folds):
            found = learned(dealt.filter(F.col("_fold") != fold), method)
            label = next(iter(classifiers.values())).label
            ready = stored(found.apply(dealt).select(id_col, label, "_fold", "features"), "fold_features")
            for classifier, config in classifiers.items():
                scorer = fitted(ready.filter(F.col("_fold") != fold), config)
                for part, test in (("train", F.col("_fold") != fold), ("test", F.col("_fold") == fold)):
                    got = measured(ready.filter(test), scorer)
                    made.append((name, classifier, fold, part, *[None if got[m] is None else float(got[m]) for m in (*MEASURES, "roc_auc")]))
    return rows.sparkSession.createDataFrame(made, "method string, classifier string, fold int, part string, " + ", ".join(f"{m} double" for m in (*MEASURES, "roc_auc")))


def chosen(fits: DataFrame, measure: str = "f_beta") -> DataFrame:
    """(method, classifier, mean, deviation, train, rank): the best pair first; ties by name."""
    mean = lambda part, f: f(F.when(F.col("part") == part, F.col(measure)))
    by_pair = fits.groupBy("method", "classifier").agg(mean("test", F.avg).alias("mean"), mean("test", F.stddev_pop).alias("deviation"), mean("train", F.avg).alias("train"))
    return by_pair.orderBy(F.desc_nulls_last("mean"), "method", "classifier")


@dataclass(frozen=True)
class Trained:
    features: Fitted
    scorer: Scorer
    sidecar: dict

    def score(self, rows: DataFrame) -> DataFrame:
        return self.scorer.score(self.features.apply(rows)).drop("features")


def trained(rows: DataFrame, method: Method, config: Config, path: str | None = None, target_recall: float = 0.95, id_col: str = "doc_id", shares: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42) -> Trained:
    """Split by class, features and model from the training part, the threshold that reaches the recall on the validation part, measures of the
    validation and test parts, and, with a path, the models and a JSON sidecar under it. Rows without a label are left out."""
    ready = rows.filter(F.col(config.label).isNotNull())
    split = stored(stratified(ready, config.label, id_col, shares, seed), "split")
    part = lambda i: split.filter(F.col("split") == i)
    features = learned(part(0), method)
    made = stored(features.apply(split).select(id_col, config.label, "split", "features"), "split_features")
    of = lambda i: made.filter(F.col("split") == i)
    first = fitted(of(0), config)
    found = recall_thresholds(first.score(of(1)), "probability", config.label, (target_recall,)).first()
    threshold = float(found["threshold"]) if found else config.threshold
    scorer = Scorer(Config(config.estimator, config.params, threshold, config.label, config.features, config.balanced), first.model, first.slope, first.offset)
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    sidecar = {"method": vars(method) | {"numbers": list(method.numbers)}, "model": scorer.info(), "target_recall": target_recall, "threshold": threshold, "rows": {n: sizes.get(i, 0) for i, n in enumerate(("train", "validation", "test"))}, "validation": measured(of(1), scorer), "test": measured(of(2), scorer), "seed": seed}
    sidecar = json.loads(json.dumps(sidecar, default=lambda v: None if v is None else float(v)))
    if path:
        saved(Trained(features, scorer, sidecar), path)
    return Trained(features, scorer, sidecar)


def saved(found: Trained, path: str) -> None:
    """The classifier (``registry.save``), the pipelines, the components and the sidecar under a path."""
    spark = SparkSession.active()
    registry.save(found.scorer, f"{path}/classifier", spark)
    for name, model in (("terms", found.features.terms), ("scaler", found.features.scaler)):
        if model is not None:
            model.write().overwrite().save(f"{path}/{name}")
    if found.features.components is not None:  # vocabulary x components
        c = found.features.components
        rows = [(-1, [c.residual, c.total, float(c.passes)]), (-2, c.values.tolist()), *enumerate(c.basis.tolist())]
        spark.createDataFrame(rows, "place int, row array<double>").write.mode("overwrite").parquet(f"{path}/components")
    spark.createDataFrame([(json.dumps(found.sidecar, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def loaded(path: str) -> Trained:
    """What ``saved`` saved."""
    spark = SparkSession.active()
    sidecar = json.loads(spark.read.text(f"{path}/sidecar").first()[0])
    method = Method(**sidecar["method"] | {"numbers": tuple(sidecar["method"]["numbers"])})
    components = None
    if method.text is not None and method.components:
        rows = {r.place: r.row for r in spark.read.parquet(f"{path}/components").collect()}
        residual, total, passes = rows.pop(-1)
        values = rows.pop(-2)
        components = factors.Latent(np.array(values), np.array([rows[i] for i in range(len(rows))]), residual, total, int(passes))
    terms = PipelineModel.load(f"{path}/terms") if method.text is not None else None
    scaler = PipelineModel.load(f"{path}/scaler") if method.numbers else None
    return Trained(Fitted(method, terms, components, scaler), registry.load(f"{path}/classifier", spark), sidecar)
