"""Paged services as Spark sources, in batch and as a stream.

``paged_source`` makes a data source of a client: any picklable function of (query, start, end, page) that returns the page's records and the
token of the next page or None. A partition is a query and a window of days; page tokens stay inside it, so partitions
are read in parallel and a lost task asks its own pages again. Each call gives a row that says how it went, so an error costs the rest of its
window and is seen in the result; the run goes on.

The stream's offset is a day: each batch covers the windows after the last one, up to ``until`` (today by default). Restarted from its checkpoint, it
asks for no window twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Client = Callable[[str, str, str, str | None], tuple[Sequence[dict], str | None]]

SCHEMA = "query string, start date, page int, place int, record string, error string"


class Window(InputPartition):
    def __init__(self, query: str, start: date, end: date):
        self.query, self.start, self.end = query, start, end


def windows(queries: Sequence[str], start: date, end: date, days: int) -> list[Window]:
    """Windows of days from start up to (not including) end, for each query."""
    cuts = [start + timedelta(days=i) for i in range(0, max((end - start).days, 0), days)]
    return [Window(q, c, min(c + timedelta(days=days), end)) for c in cuts for q in queries]


def pages(client: Client, part: Window | None, most: int, retries: int) -> Iterator[tuple]:
    """For each call a row without a record (place -1, error if it failed), then a row a record. A page that fails ``retries`` times more ends its window.
    No window (Spark reads a source without partitions once, with None) has no rows."""
    token, page = None, 0
    if part is None:
        return
    while page < most:
        found, problem = None, None
        for _ in range(retries + 1):
            try:
                found, following = client(part.query, part.start.isoformat(), part.end.isoformat(), token)
                problem = None
                break
            except Exception as e:  # whatever a client raises, it costs this page
                problem = f"{type(e).__name__}: {e}"
                yield part.query, part.start, page, -1, None, problem
        if problem is not None:
            return
        yield part.query, part.start, page, -1, None, None
        for place, record in enumerate(found):
            yield part.query, part.start, page, place, json.dumps(record, sort_keys=True, default=str), None
        if not following or following == token:
            return
        token, page = following, page + 1


def paged_source(name: str, client: Client) -> type[DataSource]:
    """A data source class of this name, to be registered. Options: queries (a JSON list), start, until (days), days (of a window), pages (of a window, at most), retries."""

    def read_as(options: dict[str, str]) -> tuple[list[str], date, date, int, int, int]:
        until = options.get("until")
        return json.loads(options.get("queries", "[]")), date.fromisoformat(options["start"]), date.fromisoformat(until) if until else date.today(), int(options.get("days", "1")), int(options.get("pages", "1000")), int(options.get("retries", "0"))

    class Batch(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.settings = read_as(options)

        def partitions(self) -> list[Window]:
            queries, start, until, days, _, _ = self.settings
            return windows(queries, start, until, days)

        def read(self, partition: Window) -> Iterator[tuple]:
            return pages(client, partition, *self.settings[4:])

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.settings = read_as(options)

        def initialOffset(self) -> dict:
            return {"day": self.settings[1].isoformat()}

        def latestOffset(self) -> dict:
            return {"day": max(self.settings[1], self.settings[2]).isoformat()}

        def partitions(self, start: dict, end: dict) -> list[Window]:
            return windows(self.settings[0], date.fromisoformat(start["day"]), date.fromisoformat(end["day"]), self.settings[3])

        def read(self, partition: Window) -> Iterator[tuple]:
            return pages(client, partition, *self.settings[4:])

        def commit(self, end: dict) -> None:
            """Nothing is held for a window once its rows are given."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Batch:
            return Batch(dict(self.options))

        def streamReader(self, schema) -> Stream:
            return Stream(dict(self.options))

    return Paged


def read_service(spark: SparkSession, client: Client, name: str, queries: Sequence[str], start: str, until: str, stream: bool = False, **options: int) -> DataFrame:
    """The service's rows (SCHEMA), as a table or a stream."""
    spark.dataSource.register(paged_source(name, client))
    reader = (spark.readStream if stream else spark.read).format(name)
    for key, value in {"queries": json.dumps(list(queries)), "start": start, "until": until, **options}.items():
        reader = reader.option(key, str(value))
    return reader.load()


def articles(rows: DataFrame, mapping: Callable[[Column], Column]) -> DataFrame:
    """Records as articles (``answers.article_of_a`` and the like), those that map to none left out."""
    return rows.filter("record IS NOT NULL").select("query", mapping(F.col("record")).alias("a")).filter("a IS NOT NULL").select("query", "a.*")


def calls(rows: DataFrame) -> DataFrame:
    """(query, calls, failed, records): what a run asked and got."""
    return rows.groupBy("query").agg(F.count_if(F.col("place") == -1).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("record").alias("records"))
