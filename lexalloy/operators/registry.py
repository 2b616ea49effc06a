"""Tables around models: saved classifiers, measures of runs, prompts, alerts, explanations as text."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import classification
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import latest_version
from .models import Config, Scorer


def save(scorer: Scorer, path: str, spark: SparkSession) -> None:
    """The model and, beside it, its config as one JSON line."""
    scorer.model.write().overwrite().save(f"{path}/model")
    config = asdict(scorer.config)
    row = [(type(scorer.model).__name__, config["estimator"], [(k, str(v)) for k, v in config["params"]], config["threshold"], config["label"], config["features"], config["balanced"], scorer.slope, scorer.offset)]
    schema = "kind string, estimator string, params array<struct<name:string,value:string>>, threshold double, label string, features string, balanced boolean, slope double, offset double"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load(path: str, spark: SparkSession) -> Scorer:
    r = spark.read.schema("kind string, estimator string, params array<struct<name:string,value:string>>, threshold double, label string, features string, balanced boolean, slope double, offset double").json(f"{path}/config").first()
    model = getattr(classification, r.kind).load(f"{path}/model")
    config = Config(r.estimator, tuple((p["name"], p["value"]) for p in r.params or ()), r.threshold, r.label, r.features, r.balanced)
    return Scorer(config, model, r.slope, r.offset or 0.0)


def tracked(spark: SparkSession, path: str, run: str, stage: str, values: dict[str, float]) -> None:
    """Appends a row for each measure of a run's stage."""
    spark.createDataFrame([(run, stage, k, float(v)) for k, v in values.items()], "run string, stage string, measure string, value double").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_measures(tracked_rows: DataFrame) -> DataFrame:
    """A row a run and stage, with each measure's last value as a column's map entry."""
    last = tracked_rows.groupBy("run", "stage", "measure").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("run", "stage").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("measure", "value")))).alias("measures"))


def current_prompts(prompts: DataFrame) -> DataFrame:
    """The latest version of each prompt. prompts: model (the prompt's name), version (array of numbers), text."""
    return latest_version(prompts, F.col("version"))


def alerts(drift: DataFrame, moderate: float = 0.1, severe: float = 0.25) -> DataFrame:
    """A row for each drifted classifier: severity by score, and a message. drift: classifier, score, drifted."""
    severity = F.when(F.col("score") >= severe, "critical").when(F.col("score") >= moderate, "warning").otherwise("info")
    message = F.format_string("%s drifted: score %.3f", F.col("classifier"), F.col("score"))
    return drift.filter("drifted").select("classifier", "score", severity.alias("severity"), message.alias("message"))


def explanation(probability: Column, words: Column) -> Column:
    """``0.83: +rise (0.40), -fall (0.10)`` for an array of (word, weight), heaviest first as given."""
    parts = F.transform(words, lambda w: F.concat(F.when(w.weight >= 0, F.lit("+")).otherwise(F.lit("-")), w.word, F.format_string(" (%.2f)", F.abs(w.weight))))
    return F.concat(F.format_string("%.2f: ", probability), F.array_join(parts, ", "))
