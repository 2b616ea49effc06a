"""Bookkeeping of runs as an append-only table: a row when a run starts, a row when it ends, folded into a row a run when read.

Nothing is updated in place, so runs may overlap and a lost executor or a killed driver leaves at worst a run that is still
``running``. Counters are aggregates over the rows that a run handled, computed where those rows are.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, kind string, event string, at timestamp, status string, error string, config string, counters map<string,bigint>"


def started(spark: SparkSession, path: str, run_id: str, kind: str, config: Mapping[str, object] | None = None) -> None:
    """Appends the row of a run that begins; its config as JSON with sorted keys."""
    row = [(run_id, kind, "start", None, "running", None, None if config is None else json.dumps(dict(config), sort_keys=True), None)]
    _append(spark.createDataFrame(row, SCHEMA).withColumn("at", F.current_timestamp()), path)


def completed(handled: DataFrame, path: str, run_id: str, kind: str, counters: Mapping[str, Column], status: str = "success", error: str | None = None) -> None:
    """Appends the row of a run that ends. counters: aggregates over the handled rows; a null one (as of a sum over none) counts 0."""
    totals = handled.agg(F.count("*").alias("_handled"), *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(k) for k, c in counters.items()])
    held = F.create_map(*[x for k in counters for x in (F.lit(k), F.col(f"`{k}`"))]) if counters else F.lit(None).cast("map<string,bigint>")
    text = lambda v: F.lit(v).cast("string")
    _append(totals.select(text(run_id).alias("run_id"), text(kind).alias("kind"), text("end").alias("event"), F.current_timestamp().alias("at"), text(status).alias("status"), text(error).alias("error"), text(None).alias("config"), held.alias("counters")), path)


def _append(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)


def folded(events: DataFrame) -> DataFrame:
    """A row a run: started_at (its first start), completed_at, status, error and counters of its last end (running, nulls without one), config
    of its last start, duration in seconds. A run that ended without a recorded start keeps its end."""
    begins, ends = F.col("event") == "start", F.col("event") == "end"
    last = F.max_by(F.when(ends, F.struct("at", "status", "error", "counters")), F.when(ends, F.col("at")))
    rows = events.groupBy("run_id").agg(F.max("kind").alias("kind"), F.min(F.when(begins, F.col("at"))).alias("started_at"), F.max_by(F.when(begins, F.col("config")), F.when(begins, F.col("at"))).alias("config"), last.alias("end"))
    seconds = F.unix_timestamp(F.col("end.at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return rows.select("run_id", "kind", "started_at", F.col("end.at").alias("completed_at"), F.coalesce("end.status", F.lit("running")).alias("status"), F.col("end.error").alias("error"), "config", F.col("end.counters").alias("counters"), seconds.alias("seconds"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    return folded(spark.read.schema(SCHEMA).parquet(path))


def cost(counters: Column, prices: Mapping[str, float]) -> Column:
    """What a run cost: each priced counter times its price a unit; missing counters cost nothing."""
    return sum((F.coalesce(counters[name], F.lit(0)) * F.lit(float(price)) for name, price in prices.items()), F.lit(0.0))
