"""The corpus pipeline: quality classifier, near duplicates, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage works on all rows of docs. Ids may repeat and any column may be null, so decisions are joined back by a row's file
and its place in that file: both sides read the same, however the files are split and whatever becomes of executors.

Defined results: null texts count as empty in each stage (and stay null); empty texts have no near duplicates; repeated
rows are copies of which one stays; very long texts are judged whole; an empty table passes all stages; columns that aren't
columns of documents are dropped. The last stage returns the pieces of ``lexalloy.llm.packing``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalloy.llm import boosting, decontamination, near_duplicates, packing, secrets
from lexalloy.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5; the classifier is fitted on all labelled documents. Texts are stored with
    their statistics, so that nothing is joined back."""
    rows = docs.select(*COLUMNS, F.col("text").alias("_body"))  # scored keeps no text of its own
    scored = boosting.scored(rows, table(spark, sf_dir, "labels"), learn=F.lit(True), keep=("_body", *COLUMNS[2:]), threshold=0.5)
    return scored.filter("predicted = 1").select("doc_id", F.col("_body").alias("text"), *COLUMNS[2:])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each class of near duplicates."""
    rows = numbered(docs)
    found = near_duplicates.grouped(rows.withColumns({"_file": "_row.file", "_at": "_row.at"}), keep=("_file", "_at"))
    return without(rows, found.filter(~F.col("first")).select(F.struct(F.col("_file").alias("file"), F.col("_at").alias("at")).alias("_row")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    rows = numbered(docs)
    found = decontamination.judged(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(rows, found.filter("contaminated").select(F.col("doc_id").alias("_row")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are redacted, and n_chars counts the text as it then is."""
    rows = numbered(docs)
    found = secrets.scanned(rows, row=F.col("_row")).filter(F.size("spans") > 0).select(F.col("row").alias("_row"), "spans")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("spans")))
    out = rows.join(found, "_row", "left").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into windows of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("secrets", redact_secrets), ("packing", pack)]

#: Trained models, order MinHash and BPE have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and _row: the row's file and its place there. Rows that come from no file are stored first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.select(*COLUMNS, place.alias("_row"))
    except AnalysisException:  # no scan of files, or none whose places are known here
        return stored(docs.select(*COLUMNS), "numbered").select(*COLUMNS, place.alias("_row"))


def without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """rows less the rejected row numbers."""
    return rows.join(rejected, "_row", "left_anti").select(*COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
