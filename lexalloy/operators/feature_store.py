"""Features kept by content: what was computed for a text under a configuration is never computed again.

A text's key is its SHA-256, a configuration's that of its canonical JSON; each configuration has a folder of its own under a path that driver
and executors share, with the configuration beside it. A run computes the texts that the folder doesn't hold, each once however often it
occurs, and appends them in one commit: a run that fails adds nothing and harms nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored


class FeatureStore:
    """Null texts count as empty. One run at a time may write a configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def key(self, config: Mapping[str, object]) -> str:
        return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def _there(self, folder: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _folder(self, config: Mapping[str, object]) -> str:
        return f"{self.path}/features/{self.key(config)}"

    def known(self, config: Mapping[str, object]) -> DataFrame | None:
        """hash and features of all texts held under a configuration; None before the first."""
        return self.spark.read.parquet(self._folder(config)) if self._there(self._folder(config)) else None

    def features(self, docs: DataFrame, config: Mapping[str, object], compute: Callable[[DataFrame], DataFrame], text_col: str = "text") -> tuple[DataFrame, int]:
        """docs with the columns that compute adds to (hash, text), and for how many texts it was asked. Other columns of docs stay; those
        of the features' names are replaced."""
        keyed = docs.withColumn("_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        before = self.known(config)
        asked = keyed.select(F.col("_hash").alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if before is not None:
            asked = asked.join(before.select("hash"), "hash", "left_anti")
        asked = stored(asked.groupBy("hash").agg(F.first("text").alias("text")), "asked")
        count = asked.count()
        if count or before is None:
            compute(asked).drop("text").write.mode("append").parquet(self._folder(config))
            self.spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/configs/{self.key(config)}")
        held = self.known(config)
        found = held.select(F.col("hash").alias("_hash"), *[c for c in held.columns if c != "hash"])
        return keyed.drop(*[c for c in held.columns if c != "hash" and c in docs.columns]).join(found, "_hash", "left").drop("_hash"), count

    def configs(self) -> list[dict]:
        """All configurations that something is held under."""
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/configs/*").collect()] if self._there(f"{self.path}/configs") else []

    def counts(self, config: Mapping[str, object]) -> int:
        held = self.known(config)
        return 0 if held is None else held.count()

    def forget(self, config: Mapping[str, object]) -> None:
        """Deletes what is held under a configuration."""
        for folder in (self._folder(config), f"{self.path}/configs/{self.key(config)}"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
