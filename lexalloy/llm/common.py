"""What the training-data operators share: reading tables, the shared folder, folds, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset: one in the warehouse, which
    executors share too, or, if Spark runs in one process, a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if configured is None:
        one_process = sc.master == "local" or sc.master.startswith("local[")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexalloy-") if one_process else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexalloy-shared")
        configured = sc._jsc.sc().getCheckpointDir().get()
    return configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: each row is computed once, lineage ends here,
    and losing an executor loses nothing. Spark deletes the folder when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexalloy-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that no later step reads."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexalloy-" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside passes at most ``rows`` rows at once to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def split_join(left: DataFrame, right: DataFrame, on: list[str], share: int = 1_000, least: int = 1_000) -> DataFrame:
    """left joined with right, whose keys are unique, where a few keys may hold much of left. Keys with over 1 / share of
    left's rows (so there are less than ``share`` of them) are joined by broadcast, which leaves left's rows where they are;
    all others by a shuffle. Rows without a partner go. left is read three times, so it should be stored."""
    key = F.xxhash64(*on)
    total = left.count()
    if total <= least:
        return left.join(right, on)
    hot = [r[0] for r in left.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") > max(total // share, least)).select("k").collect()]
    if not hot:
        return left.join(right, on)
    here = key.isin(hot)  # a hash decides on the way only
    return left.filter(here).join(F.broadcast(right.filter(here)), on).unionByName(left.filter(~here).join(right.filter(~here), on))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where the fold is the held-out one; a null id is not held out."""
    return F.coalesce(fold(doc_id, modulus) == F.lit(remainder), F.lit(False))


def bounded_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """At most about max_rows rows (exactly all when there are fewer), picked by a hash of the key: the same rows at every run."""
    n = df.count()
    if n <= max_rows:
        return df
    parts = 1_000_000
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(parts)) < int(parts * 0.98 * max_rows / n))


def let(value: Column, body) -> Column:
    """body(v) with value computed once a row, however often body uses v."""
    return F.element_at(F.transform(F.array(value), body), 1)
