"""Sources and sinks: JSON lines with declared schemas, day-named prediction logs, documents, feeds, and table edits on Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PREDICTION = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("probability", T.DoubleType()), T.StructField("prediction", T.IntegerType()), T.StructField("text_length", T.LongType()), T.StructField("has_brand_context", T.BooleanType())])


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder for checkpoints. Where it is unset: one in the warehouse, which executors share too, or, if Spark runs
    in one process, a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found is None:
        one_process = sc.master == "local" or sc.master.startswith("local[")
        found = tempfile.mkdtemp(prefix="lexalloy-") if one_process else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexalloy-shared"
        sc.setCheckpointDir(found)
    return found


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_prediction_logs(spark: SparkSession, folder: str, classifier: str, start: str, end: str) -> DataFrame:
    """Rows of ``{classifier}_predictions_{yyyyMMdd}.jsonl`` files whose file date lies in [start, end] (dates). The filter is on the file's name, so other files aren't opened."""
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})\.jsonl$", 1), "yyyyMMdd")
    return spark.read.schema(PREDICTION).json(f"{folder}/{classifier}_predictions_*.jsonl").filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Appends to the log, a folder for each classifier and UTC day."""
    df.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("classifier", "day").json(path)


def write_reference(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_feed(items: DataFrame, path: str, summary: dict[str, Column], order: Sequence[Column], limit: int = 1000) -> None:
    """One JSON document: the summary's columns (over all items) and the first ``limit`` items in the order given, nested as they are.
    The limit is what a feed is, and bounds the one row."""
    total = items.agg(*[c.alias(k) for k, c in summary.items()])
    first = items.orderBy(*order).limit(limit).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    listed = first.agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*items.columns).alias("item")))).alias("l")).select(F.transform("l", lambda x: x["item"]).alias("items"))
    total.crossJoin(listed).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_xml(items: DataFrame, path: str, root: str = "feed", row: str = "entry") -> None:
    items.write.mode("overwrite").option("rootTag", root).option("rowTag", row).xml(path)


def inserted_if_absent(new: DataFrame, stored: DataFrame, id_col: str = "article_id", title_col: str = "title") -> DataFrame:
    """new with outcome: duplicate_id, duplicate_title (case and outer spaces ignored) or new. Append the new ones."""
    key = lambda c: F.lower(F.trim(c))
    ids = stored.select(F.col(id_col).alias("_id")).distinct()
    titles = stored.select(key(F.col(title_col)).alias("_title")).filter("_title <> ''").distinct()
    joined = new.join(ids, F.col(id_col) == F.col("_id"), "left").join(titles, key(F.col(title_col)) == F.col("_title"), "left")
    outcome = F.when(F.col("_id").isNotNull(), F.lit("duplicate_id")).when(F.col("_title").isNotNull(), F.lit("duplicate_title")).otherwise(F.lit("new"))
    return joined.withColumn("outcome", outcome).drop("_id", "_title")


def replaced_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """stored without the children of the parents in new, and new's children."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the changed columns of the rows in changes; a null change is a change."""
    mine = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(mine, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def cascade(gone: DataFrame, articles: DataFrame, chunks: DataFrame, labels: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the articles in gone: chunks and labels go with their article, evidence with its label; evidence keeps no link to a chunk that went."""
    ids = gone.select(F.col("id").alias("article_id"))
    kept_labels = labels.join(ids, "article_id", "left_anti")
    lost_labels = labels.join(ids, "article_id", "left_semi").select(F.col("id").alias("brand_label_id"))
    lost_chunks = chunks.join(ids, "article_id", "left_semi").select(F.col("id").alias("_chunk"))
    kept_evidence = evidence.join(lost_labels, "brand_label_id", "left_anti").join(lost_chunks, F.col("chunk_id") == F.col("_chunk"), "left")
    kept_evidence = kept_evidence.withColumn("chunk_id", F.when(F.col("_chunk").isNull(), F.col("chunk_id"))).drop("_chunk")
    return {"articles": articles.join(gone.select("id"), "id", "left_anti"), "chunks": chunks.join(ids, "article_id", "left_anti"), "labels": kept_labels, "evidence": kept_evidence}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: rows are computed once, and a lost executor loses nothing. Spark deletes
    the folder when its JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexalloy-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)
