"""The paged catalogue as a data source that Spark plans itself.

    register(spark)
    spark.read.format("catalogue").option("base", url).load().where("id > 20")

One partition a listing page, and each row one entry with its detail body.  The
range of ids that a query asks for is pushed down: pages before it aren't
asked for, entries outside it cost no detail request, and ``limit`` ends the
listing at the page that holds that many entries.  The first page is asked for
once, by the planner, and travels to its task.  As a stream (``readStream``)
the offset is the greatest id that was announced, so a restart goes on behind
the last batch that was committed.

Rows: ``page``, ``place`` (in the listing, from 0), ``id``, ``name``, ``body``.
An id listed twice gives two rows, see ``records`` for the first of each.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ROWS = "page long, place int, id long, name string, body string"


def fetched(url: str, timeout: float = 30.0) -> str:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"Failed to fetch {url}: {e.code}") from None


@dataclass
class Page(InputPartition):
    number: int
    low: int
    high: int
    body: str | None = None


class Listing:
    """The listing below ``base``: ``<base>?offset=..&limit=..``, details at ``<base>/<id>/``."""

    def __init__(self, options: dict):
        self.base, self.size = options["base"].rstrip("/"), int(options.get("pageSize", 20))

    def page(self, number: int) -> str:
        return fetched(f"{self.base}?offset={number * self.size}&limit={self.size}")

    def pages(self, low: int, high: int, first: str, limit: int | None = None) -> list[Page]:
        """The pages that can hold ids of low..high, for a listing by id without gaps or doubles before it."""
        total = json.loads(first)["count"]
        high = min(high, total)
        if low > high:
            return []
        start, stop = max(low - 1, 0) // self.size, -(-total // self.size)
        if limit is not None:
            stop = min(stop, start - (-(limit + (max(low, 1) - 1) % self.size) // self.size))
        elif high < total:
            stop = -(-high // self.size)
        return [Page(n, low, high, None if n else first) for n in range(start, stop)]

    def read(self, page: Page) -> Iterator[tuple]:
        for place, entry in enumerate(json.loads(page.body or self.page(page.number))["results"]):
            name, found = entry["name"].strip(), re.search(r"/(\d+)/?$", re.sub(r"[?#].*$", "", entry["url"], flags=re.S))
            if not found or not name:
                raise ValueError(f"no id in {entry['url']}" if name else f"an entry of page {page.number} has no name")
            if page.low <= int(found[1]) <= page.high:
                yield page.number, place, int(found[1]), name, fetched(f"{self.base}/{found[1]}/")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing, self.low, self.high = Listing(options), 1, (1 << 63) - 1
        self.limit = int(options["limit"]) if "limit" in options else None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("id",):
                continue
            if getattr(f, "attribute", None) != ("id",) or getattr(f, "value", None) is None:
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            if isinstance(f, In):
                self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
            if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f

    def partitions(self):
        return self.listing.pages(self.low, self.high, self.listing.page(0), self.limit) if self.low <= self.high else []

    def read(self, partition):
        return self.listing.read(partition) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    """Offsets are {"prefix": greatest id so far}."""

    def __init__(self, options: dict):
        self.listing, self.start = Listing(options), int(options.get("startingPrefix", 0))

    def initialOffset(self):
        return {"prefix": self.start}

    def latestOffset(self):
        return {"prefix": max(self.start, json.loads(self.listing.page(0))["count"])}

    def partitions(self, start, end):
        if start["prefix"] >= end["prefix"]:
            return []
        return self.listing.pages(start["prefix"] + 1, end["prefix"], self.listing.page(0))

    def read(self, partition):
        return self.listing.read(partition) if partition is not None else iter(())


class CatalogueSource(DataSource):
    @classmethod
    def name(cls):
        return "catalogue"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)


def records(rows: DataFrame, numbers: str = "index_numbers", index: str = "index") -> DataFrame:
    """The source's rows as validated records, the first of each id."""
    from ..operators.keys import first_of_each
    from .catalogue_feed import normalised

    return normalised(first_of_each(rows, ["id"], [F.asc("page"), F.asc("place")]), numbers, index)


def follow(spark: SparkSession, base: str, store, checkpoint: str, at, **options) -> int:
    """Loads into ``store`` what the catalogue has announced since the last
    call, and returns how many records that was.  A batch that was cut off is
    inserted again on restart; what is there already is left alone, so it
    counts once.  ``at`` is the time written on new records."""
    store.prepare()
    before = store.table("species").count()
    stream = spark.readStream.format("catalogue").option("base", base).options(**options).load()

    def insert(batch: DataFrame, _: int) -> None:
        store.insert(records(batch), at)

    query = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.table("species").count() - before
