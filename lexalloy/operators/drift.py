"""Drift of a whole table: every column of a current set against a reference, all in one pass, and a verdict on the table.

Numbers are compared by the two-sample Kolmogorov-Smirnov distance (exact: running sums over ranges of values, for all columns together),
categories by Pearson's chi-squared with the Wilson-Hilferty normal score, both against a critical value. Columns are laid out
as (column, value) rows and counted before anything is shuffled by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import halves, running

#: The 5 % points of the Kolmogorov distribution and of the normal one (one-sided).
KS_CRITICAL, NORMAL_CRITICAL = 1.3581, 1.6449

SCHEMA = "column string, kind string, n_reference long, n_current long, missing_reference double, missing_current double, statistic double, critical double, drifted boolean, status string"


def windowed(rows: DataFrame, at: str, until: datetime, days: int = 7) -> DataFrame:
    """The rows of the last days before (and without) until: whatever is pushed down to the scan prunes day folders."""
    return rows.filter((F.col(at) >= F.lit(until - timedelta(days=days))) & (F.col(at) < F.lit(until)))


def _long(rows: DataFrame, columns: Sequence[str], kind: str, side: int) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("v")) for c in columns])).alias("c")
    return rows.select(cells).select("c.*", F.lit(1 - side).cast("long").alias("a"), F.lit(side).cast("long").alias("b"))


def _both(reference: DataFrame, current: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """column, v, a, b: how often each value stands on either side (one aggregation for all columns)."""
    return _long(reference, columns, kind, 0).unionByName(_long(current, columns, kind, 1)).groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _row(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """One row a column, also for those without a value on a side."""
    out = counts.join(found, "column", "left")
    enough = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    status = F.when(enough, F.lit("compared")).otherwise(F.lit("no values"))
    share = lambda missing, n: F.try_divide(missing, F.col(n) + missing)
    return out.select(
        "column", F.lit(kind).alias("kind"), "n_reference", "n_current", share(F.col("null_a"), "n_reference").alias("missing_reference"), share(F.col("null_b"), "n_current").alias("missing_current"),
        F.when(enough, F.col("statistic")).alias("statistic"), F.when(enough, F.col("critical")).alias("critical"), F.coalesce(enough & (F.col("statistic") > F.col("critical")), F.lit(False)).alias("drifted"), status.alias("status"),
    )


def _counts(both: DataFrame) -> DataFrame:
    null = F.col("v").isNull()
    total = lambda side, missing: F.coalesce(F.sum(F.when(null if missing else ~null, F.col(side))), F.lit(0))
    return both.groupBy("column").agg(total("a", False).alias("n_reference"), total("b", False).alias("n_current"), total("a", True).alias("null_a"), total("b", True).alias("null_b"))


def compared(reference: DataFrame, current: DataFrame, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """A row a column that both tables have: sizes, missing shares, statistic, its 5 % point, drifted, status. NaN counts as missing."""
    there = set(reference.columns) & set(current.columns)
    numbers, categories = [c for c in numbers if c in there], [c for c in categories if c in there]
    parts = []
    if numbers:
        both = _both(reference, current, numbers, "double").withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
        known = both.filter("v IS NOT NULL").groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        sums = running(known, "v", ("a", "b"), group="column")
        gap = F.abs(F.try_divide("a_upto", "a_all") - F.try_divide("b_upto", "b_all"))
        found = sums.groupBy("column").agg(F.max(gap).alias("statistic"), F.max("a_all").alias("n"), F.max("b_all").alias("m"))
        found = found.select("column", "statistic", (F.lit(KS_CRITICAL) * F.sqrt(F.try_divide(F.col("n") + F.col("m"), F.col("n").cast("double") * F.col("m")))).alias("critical"))
        parts.append(_row(found, _counts(both), "number"))
    if categories:
        both = _both(reference, current, categories, "string")
        counts = _counts(both)
        share = counts.select("column", (F.col("n_reference") / (F.col("n_reference") + F.col("n_current"))).alias("p"))
        cells = both.filter("v IS NOT NULL").join(F.broadcast(share), "column")  # a row a column
        n = F.col("a") + F.col("b")
        square = lambda seen, p: F.try_divide((seen - n * p) * (seen - n * p), n * p)
        chi = cells.groupBy("column").agg(F.sum(square(F.col("a"), F.col("p")) + square(F.col("b"), 1 - F.col("p"))).alias("chi"), (F.count("*") - 1).cast("double").alias("k"))
        spread = F.try_divide(F.lit(2.0), 9 * F.col("k"))
        score = F.when(F.col("k") > 0, (F.cbrt(F.col("chi") / F.col("k")) - (1 - spread)) / F.sqrt(spread)).otherwise(F.lit(0.0))
        parts.append(_row(chi.select("column", score.alias("statistic"), F.lit(NORMAL_CRITICAL).alias("critical")), counts, "category"))
    if not parts:
        return reference.sparkSession.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(reference: DataFrame | None, current: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), order: str | None = None, limit: float = 0.5) -> DataFrame:
    """``compared`` and a row for the table (column '(all)'): statistic is the share of drifted columns among those compared, drifted where it reaches
    limit. Without a reference the earlier half of current (by order) is one. Status of that row: compared, halves, or no data (nothing to compare: not drifted)."""
    status = "compared"
    if reference is None:
        if order is None:
            raise ValueError("without a reference an order is needed")
        reference, current = halves(current, order)
        status = "halves"
    rows = compared(reference, current, numbers, categories)
    used = F.col("status") == "compared"
    share = F.try_divide(F.count_if(F.col("drifted")), F.count_if(used))
    verdict = rows.agg(F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"), F.avg("missing_reference").alias("missing_reference"), F.avg("missing_current").alias("missing_current"), share.alias("statistic"))
    known = F.col("statistic").isNotNull()
    verdict = verdict.select(
        F.lit("(all)").alias("column"), F.lit("table").alias("kind"), F.coalesce("n_reference", F.lit(0)).cast("long").alias("n_reference"), F.coalesce("n_current", F.lit(0)).cast("long").alias("n_current"), "missing_reference", "missing_current",
        "statistic", F.lit(float(limit)).alias("critical"), F.coalesce(F.col("statistic") >= limit, F.lit(False)).alias("drifted"), F.when(known, F.lit(status)).otherwise(F.lit("no data")).alias("status"),
    )
    return rows.unionByName(verdict)


