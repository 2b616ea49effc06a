"""The prediction log as a stream: exactly-once files, by classifier and UTC day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import PREDICTION

_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def utc_day(timestamp: Column) -> Column:
    """The day in UTC, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(timestamp) / 86_400_000_000).cast("int"))


def log_predictions(stream: DataFrame, path: str, checkpoint: str, classifier: str = "classifier") -> StreamingQuery:
    """Appends a stream of predictions (the columns of PREDICTION and a classifier) as JSON lines to folders classifier=.../day=...; ends when the source has
    no more. Late rows land in their own day. The sink's log names the files that count: a batch that a killed run half wrote leaves
    files that no reader sees. Rows without a timestamp go to the day null."""
    names = [f.name for f in PREDICTION.fields]
    rows = stream.select(*[F.col(n).cast(f.dataType) for n, f in zip(names, PREDICTION.fields, strict=True)], F.col(classifier).cast("string").alias("classifier"), utc_day(F.col("timestamp").cast("timestamp")).alias("day"))
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("timestampFormat", _FORMAT).partitionBy("classifier", "day").trigger(availableNow=True).start()


def read_logged(spark: SparkSession, path: str, classifier: str, start: str, end: str) -> DataFrame:
    """A classifier's predictions of the UTC days from start to end, both included. Only these folders are read."""
    schema = T.StructType([*PREDICTION.fields, T.StructField("classifier", T.StringType()), T.StructField("day", T.DateType())])
    found = spark.read.schema(schema).option("timestampFormat", _FORMAT).json(path)
    days = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return found.filter((F.col("classifier") == classifier) & days).select(*PREDICTION.fieldNames())
