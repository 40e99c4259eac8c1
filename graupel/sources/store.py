"""A small table store over Parquet folders: existence, insert if absent,
keyed upsert, clear, guarded reset, and the incremental synchronisation.

A record is one nested row with its children in arrays, so it is there as a
whole or not at all; the child tables are views of it (``records.Records``).
"""

from __future__ import annotations

import uuid
from datetime import datetime
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import catalogue_feed as feed
from .records import Records

SPECIES = "id long, name string, color_name string, evolves_from_species_name string, generation_name string, habitat_name string, is_baby boolean, is_legendary boolean, is_mythical boolean, seeded_at timestamp"
CHILDREN = {
    "names": "language_name: string, name: string",
    "genera": "language_name: string, genus: string",
    "index_numbers": "index_name: string, entry_number: int",
}
RECORDS = SPECIES + "".join(f", {name} array<struct<{fields}>>" for name, fields in CHILDREN.items())
STATE = "seed_name string, last_successful_sync_at timestamp"


class Store:
    """Tables below one folder, which every path must stay in."""

    def __init__(self, spark: SparkSession, url: str):
        if "://" in url and not url.startswith(("file:", "hdfs:", "viewfs:", "s3a:")) or url.startswith("http"):
            raise ValueError(f"not a storage location: {url}")
        path = unquote(urlparse(url).path) if url.startswith("file:") else url
        if path.endswith("/") and url.startswith("file:"):
            raise ValueError("the location must name the store's folder, without a slash at the end")
        self.spark, self.root = spark, url.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a table name: {name}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = self._hadoop(self.path(name))
        old = self._hadoop(f"{self.root}/_old_{name}")[1]
        if not fs.exists(p) and fs.exists(old):  # an overwrite was cut off between its two renamings
            fs.rename(old, p)
        return fs.exists(p)

    def create(self, name: str, schema: str) -> None:
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.parquet(self.path(name))

    def prepare(self) -> None:
        """All tables, made where they are missing."""
        self.create("species", RECORDS)
        self.create("sync_state", STATE)

    def reset(self, under: str) -> None:
        """Drops the store's folder, which must lie below ``under``."""
        if not self.root.startswith(under.rstrip("/") + "/") or ".." in self.root:
            raise ValueError(f"{self.root} isn't below {under}")
        fs, p = self._hadoop(self.root)
        fs.delete(p, True)
        self.prepare()

    def table(self, name: str) -> DataFrame:
        if name in CHILDREN:
            return self.records().children(name, "species_id")
        self.exists(name)
        return self.spark.read.schema({"species": SPECIES, "sync_state": STATE}[name]).parquet(self.path(name))

    def records(self) -> Records:
        """The species with their children."""
        self.exists("species")
        return Records(self.spark, self.path("species"), RECORDS, "id")

    def overwrite(self, name: str, df: DataFrame) -> None:
        """A table's new content, written beside it and moved into its place;
        the old content stays until the new one is there."""
        new = f"{self.root}/_new_{name}_{uuid.uuid4().hex}"
        df.write.parquet(new)
        there = self.exists(name)
        fs, p = self._hadoop(self.path(name))
        old = self._hadoop(f"{self.root}/_old_{name}")[1]
        fs.delete(old, True)
        if there and not fs.rename(p, old) or not fs.rename(self._hadoop(new)[1], p):
            raise OSError(f"could not move the new content of {name} into place")
        fs.delete(old, True)

    def clear(self) -> None:
        self.overwrite("species", self.records().rows().limit(0))

    def insert(self, species: DataFrame, at: datetime) -> int:
        """Records whose id isn't there; returns how many.  A name that another
        record has is an error."""
        return self.records().insert(species.withColumn("seeded_at", F.lit(at)), unique=("name",))

    def mark(self, seed: str, at: datetime) -> None:
        row = self.spark.createDataFrame([(seed, at)], STATE)
        self.overwrite("sync_state", upserted(self.table("sync_state"), row, "seed_name"))

    def last_sync(self, seed: str) -> datetime | None:
        row = self.table("sync_state").where(F.col("seed_name") == seed).limit(1).first()
        return row and row["last_successful_sync_at"]


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the new ones."""
    return old.join(new.select(*key), [*key], "left_anti").unionByName(new)


def cooling(last: Column, now: Column, days: Column | int) -> Column:
    """Whether ``now`` is less than ``days`` after ``last``; not for a null."""
    return F.coalesce((F.unix_millis(now) - F.unix_millis(last)) < F.lit(days) * 86_400_000, F.lit(False))


def sync(store: Store, base: str, fetch: feed.Fetch, now: datetime, seed: str = "species", days: int = 1) -> int:
    """Loads what the store lacks; returns the number of records saved.

    One request tells the upstream's size.  Nothing more happens during the
    cooldown after a success with all of it there; else the listing is read from
    the end of the contiguous prefix on, and what is new is fetched.  Success is
    marked when the listing was complete or had nothing new."""
    import json

    from ..operators.keys import contiguous_prefix, missing as lacking

    spark = store.spark
    store.prepare()
    first = feed.fetched(feed.listing_url(base, 0), fetch)
    total = json.loads(first)["count"]
    have = store.table("species").select("id")
    prefix = contiguous_prefix(have, "id").first()["prefix"] or 0
    last = store.last_sync(seed)
    if last is not None and (now - last).total_seconds() < days * 86_400:
        return 0
    if prefix >= total:
        store.mark(seed, now)
        return 0
    start = prefix // feed.PAGE_SIZE * feed.PAGE_SIZE
    row, after = feed.page_row(start // feed.PAGE_SIZE, first), start
    pages = spark.createDataFrame([row] if not start else [], feed.PAGE_ROWS)
    if not start:
        after = feed.PAGE_SIZE if row[3] else total
    landed = f"{store.root}/_listing_{uuid.uuid4().hex}"
    pages.unionByName(feed.listing_pages(spark, base, after, total, fetch)).write.parquet(landed)
    pages = spark.read.schema(feed.PAGE_ROWS).parquet(landed)
    listed = feed.new_summaries(pages, prefix, total)
    last = pages.agg(F.max(F.struct("ordinal", "following")).alias("last")).first()["last"]
    while last["following"] and listed.count() < total - prefix:  # the listing goes on behind what it announced
        more = feed.page_row(last["ordinal"] + 1, feed.fetched(last["following"], fetch))
        spark.createDataFrame([more], feed.PAGE_ROWS).write.mode("append").parquet(landed)
        pages = spark.read.schema(feed.PAGE_ROWS).parquet(landed)
        listed, last = feed.new_summaries(pages, prefix, total), {"ordinal": more[0], "following": more[3]}
    new = lacking(listed, have, "id").select("id")
    complete = listed.count() >= total - prefix
    saved = 0
    if not new.isEmpty():
        saved = store.insert(feed.normalised(feed.details(new, base, fetch)), now)
        if complete:
            store.mark(seed, now)
    else:
        store.mark(seed, now)
    fs, p = store._hadoop(landed)
    fs.delete(p, True)
    return saved


def saved(store: Store, base: str, fetch: feed.Fetch, now: datetime, **options) -> DataFrame:
    """A synchronisation's answer as one row: the number of records saved."""
    return store.spark.createDataFrame([(sync(store, base, fetch, now, **options),)], "saved long")


def iso(at: Column) -> Column:
    """A time as text: UTC, milliseconds, ``Z``."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
