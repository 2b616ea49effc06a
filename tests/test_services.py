"""The paged service source, the prediction log as a stream, and drift of whole tables."""

import datetime as dt
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalloy.functions import answers
from lexalloy.operators import drift
from lexalloy.sources import paged_service as ps
from lexalloy.streaming import predictions

QUERIES = ["(nike OR puma)", "climate", "broken"]


def recorded():
    """Three pages a window for the first query, one for the second; the third query fails on its second page."""

    def client(query, start, end, page):
        n = int(page or 0)
        if query == "broken" and n == 1:
            raise TimeoutError("slow")
        last = {"(nike OR puma)": 2, "climate": 0, "broken": 2}[query]
        records = [{"article_id": f"{query}|{start}|{n}|{i}", "title": f"T {i}", "pubDate": f"{start} 10:00:00", "link": "http://x/", "source_id": "s"} for i in range(2)]
        return records, (str(n + 1) if n < last else None)

    return client


def test_batch_reads_pages_windows_and_errors(spark):
    rows = ps.read_service(spark, recorded(), "recorded_batch", QUERIES, "2024-01-01", "2024-01-08", days=3)
    got = {r["query"]: r for r in ps.calls(rows).collect()}
    assert rows.rdd.getNumPartitions() == 9  # a query and a window: 3 + 3 + 1 days
    assert (got["(nike OR puma)"].calls, got["(nike OR puma)"].failed, got["(nike OR puma)"].records) == (9, 0, 18)
    assert (got["climate"].calls, got["climate"].failed, got["climate"].records) == (3, 0, 6)
    assert (got["broken"].calls, got["broken"].failed, got["broken"].records) == (6, 3, 6)  # what came before the error stays
    assert {r.error for r in rows.filter("error is not null").collect()} == {"TimeoutError: slow"}
    again = ps.read_service(spark, recorded(), "recorded_retry", ["broken"], "2024-01-01", "2024-01-02", retries=2)
    assert ps.calls(again).first().failed == 3
    articles = ps.articles(rows, answers.article_of_a)
    assert articles.count() == 30 and articles.filter("published_at is null or article_id is null").count() == 0
    assert ps.read_service(spark, recorded(), "recorded_none", QUERIES, "2024-01-08", "2024-01-08").count() == 0


def test_endless_tokens_and_bounds():
    part = ps.Window("q", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert len(list(ps.pages(lambda *a: ([{}], "same"), part, 50, 0))) == 4  # a token that doesn't move ends the window
    counter = iter(range(10**6))
    assert len(list(ps.pages(lambda *a: ([], str(next(counter))), part, 7, 0))) == 7
    assert [(w.start.day, w.end.day) for w in ps.windows(["q"], dt.date(2024, 1, 1), dt.date(2024, 1, 6), 2)] == [(1, 3), (3, 5), (5, 6)]


def test_stream_gives_what_the_batch_gives_and_goes_on(spark, tmp_path):
    def run(until):
        stream = ps.read_service(spark, recorded(), "recorded_stream", QUERIES, "2024-01-01", until, stream=True, days=1)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run("2024-01-03")
    run("2024-01-05")  # from the checkpoint: only the new days
    want = ps.read_service(spark, recorded(), "recorded_again", QUERIES, "2024-01-01", "2024-01-05", days=1).collect()
    got = spark.read.schema(ps.SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) > 50


def test_prediction_log_is_written_once_over_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("timestamp", "probability", "prediction", "text_length", "has_brand_context", "classifier"), r, strict=True))) + "\n" for r in rows))

    def run(most=1, kill=False):
        stream = spark.readStream.schema("timestamp timestamp, probability double, prediction int, text_length long, has_brand_context boolean, classifier string").option("maxFilesPerTrigger", most).json(source)
        q = predictions.log_predictions(stream, out, checkpoint)
        if kill:
            while not q.recentProgress and q.isActive:
                pass
            q.stop()  # between, or in the middle of, batches
        else:
            q.awaitTermination()

    for i in range(5):
        arrive(f"a{i}.json", [(f"2024-03-0{1 + i % 3}T23:30:00-05:00", i / 10, 1, 100 + i, True, "fp"), (f"2024-03-0{1 + i % 3}T12:00:00Z", i / 10, 0, 200 + i, False, "ep")])
    run(kill=True)
    run()
    arrive("late.json", [("2024-03-01T01:00:00Z", 0.9, 1, 999, True, "fp")])
    run()
    whole = spark.read.json(out)
    assert whole.count() == 11 and whole.select("classifier", "text_length").distinct().count() == 11
    days = {r.text_length: r.timestamp for r in predictions.read_logged(spark, out, "fp", "2024-03-02", "2024-03-03").collect()}
    assert set(days) == {100, 103, 101, 104}  # 23:30 in New York is the next day in UTC
    assert [r.text_length for r in predictions.read_logged(spark, out, "fp", "2024-03-01", "2024-03-01").collect()] == [999]
    assert predictions.read_logged(spark, out, "none", "2024-03-01", "2024-03-31").count() == 0


def ks(a, b):
    values = np.unique(np.r_[a, b])
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in values)


def test_drift_of_all_columns_at_once(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.normal(size=300) + 0.6
    same = rng.random(700).round(1)
    kinds = [["x", "y", "z"][i] for i in rng.integers(0, 3, 400)] + [["x", "y", "z"][i] for i in rng.choice(3, 300, p=[0.7, 0.2, 0.1])]
    rows = [(float(v), None if i % 50 == 0 else float(same[i]), kinds[i], "k", None, i) for i, v in enumerate(np.r_[a, b])]
    rows[5] = (float("nan"), *rows[5][1:])
    frame = spark.createDataFrame(rows, "moved double, still double, kind string, one string, empty double, i int")
    reference, current = frame.filter("i < 400"), frame.filter("i >= 400")
    got = {r["column"]: r for r in drift.report(reference, current, ("moved", "still", "empty", "absent"), ("kind", "one")).collect()}
    assert set(got) == {"moved", "still", "empty", "kind", "one", "(all)"}
    assert abs(got["moved"].statistic - ks(np.delete(a, 5), b)) < 1e-12 and got["moved"].drifted and got["moved"].n_reference == 399
    assert not got["still"].drifted and abs(got["still"].missing_reference - 8 / 400) < 1e-12
    assert got["empty"].status == "no values" and not got["empty"].drifted
    table = np.array([[Counter(kinds[s])[k] for k in "xyz"] for s in (slice(0, 400), slice(400, 700))], dtype=float)
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    chi = ((table - expected) ** 2 / expected).sum()
    assert abs(got["kind"].statistic - ((chi / 2) ** (1 / 3) - (1 - 1 / 9)) / math.sqrt(1 / 9)) < 1e-9 and got["kind"].drifted
    assert not got["one"].drifted and got["(all)"].statistic == 0.5 and got["(all)"].drifted


def test_drift_without_reference_or_data(spark):
    frame = spark.createDataFrame([(float(i), i) for i in range(40)], "v double, at int")
    got = {r["column"]: r for r in drift.report(None, frame, ("v",), order="at").collect()}
    assert got["(all)"].status == "halves" and got["v"].drifted and abs(got["v"].n_reference - 20) <= 1
    none = {r["column"]: r for r in drift.report(frame.limit(0), frame, ("v",)).collect()}
    assert none["(all)"].status == "no data" and not none["(all)"].drifted
    assert drift.report(frame, frame, ()).collect()[0].status == "no data"
    with pytest.raises(ValueError):
        drift.report(None, frame, ("v",))
    days = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 20)], "ts timestamp")
    assert drift.windowed(days, "ts", dt.datetime(2024, 1, 15), 7).agg(F.min("ts"), F.max("ts")).first()[:] == (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 14))
