"""A paged, nested catalogue as tables: fetch, validate, flatten.

``fetch(url) -> (status, body)`` is given by the caller, so that tests and
batch jobs over landed files need no network.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import Each, Flag, Nullable, Record, Text, Whole, checked
from ..functions.text import id_in_url, stripped

PAGE_SIZE = 20
Fetch = Callable[[str], tuple[int, str]]

_RESOURCE = "struct<name: string, url: string>"
PAGE = f"count long, next string, previous string, results array<{_RESOURCE}>"
DETAIL = (
    f"id long, name string, color {_RESOURCE}, evolves_from_species {_RESOURCE}, generation {_RESOURCE}, habitat {_RESOURCE}, is_baby boolean, is_legendary boolean, "
    f"is_mythical boolean, names array<struct<name: string, language: {_RESOURCE}>>, genera array<struct<genus: string, language: {_RESOURCE}>>, "
    f"{{numbers}} array<struct<entry_number: int, {{index}}: {_RESOURCE}>>"
)

RESOURCE = Record(name=Text(), url=Text(url=True))
PAGE_RULE = Record(count=Whole(0), next=Nullable(Text(url=True)), previous=Nullable(Text(url=True)), results=Each(RESOURCE))


def fetched(url: str, fetch: Fetch) -> str:
    status, body = fetch(url)
    if not 200 <= status < 300:
        raise RuntimeError(f"Failed to fetch {url}: {status}")
    return body


def listing_url(base: str, offset: int, size: int = PAGE_SIZE) -> str:
    return f"{base}?offset={offset}&limit={size}"


PAGE_ROWS = "ordinal long, body string, n long, following string"


def listing_pages(spark: SparkSession, base: str, offset: int, total: int, fetch: Fetch, parts: int = 8) -> DataFrame:
    """Pages (ordinal, body, n, following) of the listing from ``offset`` to the
    announced ``total``, fetched in up to ``parts`` tasks."""

    def run(batches):
        for b in batches:
            bodies = [fetched(listing_url(base, int(at)), fetch) for at in b["id"]]
            pages = [json.loads(x) for x in bodies]
            yield pd.DataFrame({"ordinal": b["id"] // PAGE_SIZE, "body": bodies, "n": [len(p["results"]) for p in pages], "following": [p["next"] for p in pages]})

    n = max(0, -(-(total - offset) // PAGE_SIZE))
    return spark.range(offset, max(offset, total), PAGE_SIZE, max(1, min(parts, n))).mapInPandas(run, PAGE_ROWS)


def page_row(ordinal: int, body: str) -> tuple:
    page = json.loads(body)
    return ordinal, body, len(page["results"]), page["next"]


def summaries(pages: DataFrame) -> DataFrame:
    """Pages (ordinal, body) as (ordinal, place, id, name); a bad body or an
    entry without an id is an error."""
    page = checked(F.col("body"), PAGE_RULE, f"struct<{PAGE}>", "bad page")
    rows = pages.select("ordinal", F.posexplode(page["results"]).alias("place", "entry"))
    return rows.select("ordinal", "place", id_in_url(F.col("entry.url")).alias("id"), stripped(F.col("entry.name")).alias("name"))


def new_summaries(pages: DataFrame, prefix: int, total: int) -> DataFrame:
    """Entries with prefix < id <= total, the first of each id, by id."""
    from ..operators.keys import first_of_each

    rows = summaries(pages).where((F.col("id") > prefix) & (F.col("id") <= total))
    return first_of_each(rows, ["id"], [F.asc("ordinal"), F.asc("place")]).select("id", "name").orderBy("id")


def details(ids: DataFrame, base: str, fetch: Fetch, parts: int = 8) -> DataFrame:
    """One fetch per id, in ``parts`` tasks: (id, body), by id."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "body": [fetched(f"{base}/{i}/", fetch) for i in b["id"]]})

    return ids.select(F.col("id").cast("long")).repartition(parts, "id").mapInPandas(run, "id long, body string").orderBy("id")


def detail_rule(numbers: str = "index_numbers", index: str = "index") -> Record:
    """What a detail body must hold; ``numbers`` and ``index`` are the feed's
    names of the third array and its key."""
    return Record(
        id=Whole(1), name=Text(), evolution_chain=Record(url=Text(url=True)), color=RESOURCE, evolves_from_species=Nullable(RESOURCE), generation=RESOURCE, habitat=Nullable(RESOURCE),
        is_baby=Flag(), is_legendary=Flag(), is_mythical=Flag(), names=Each(Record(name=Text(), language=RESOURCE)), genera=Each(Record(genus=Text(), language=RESOURCE)),
        **{numbers: Each(Record(entry_number=Whole(0), **{index: RESOURCE}))},
    )


def normalised(bodies: DataFrame, numbers: str = "index_numbers", index: str = "index") -> DataFrame:
    """Detail bodies (JSON) as flat species rows with three arrays of structs.
    Unknown keys are dropped; a body that breaks ``detail_rule`` is an error
    that names all its issues."""
    d = checked(F.col("body"), detail_rule(numbers, index), f"struct<{DETAIL.format(numbers=numbers, index=index)}>", "bad detail")
    rows = bodies.select(d.alias("d"))
    named = lambda r: stripped(r["name"])
    return rows.select(
        "d.id", named(F.col("d")).alias("name"), *(named(F.col(f"d.{c}")).alias(f"{c}_name") for c in ("color", "evolves_from_species", "generation", "habitat")), "d.is_baby", "d.is_legendary", "d.is_mythical",
        F.transform("d.names", lambda x: F.struct(named(x["language"]).alias("language_name"), named(x).alias("name"))).alias("names"),
        F.transform("d.genera", lambda x: F.struct(named(x["language"]).alias("language_name"), stripped(x["genus"]).alias("genus"))).alias("genera"),
        F.transform(f"d.{numbers}", lambda x: F.struct(named(x[index]).alias("index_name"), x["entry_number"].alias("entry_number"))).alias("index_numbers"),
    )


def children(species: DataFrame, array: str) -> DataFrame:
    """A child table: the parent's id and the fields of each element."""
    return species.select(F.col("id").alias("species_id"), F.explode(array).alias("e")).select("species_id", "e.*")


def with_children(species: DataFrame, child: DataFrame) -> DataFrame:
    """Each child row with its parent's columns."""
    return child.join(species, child["species_id"] == species["id"])


def from_bodies(spark: SparkSession, bodies: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "ordinal long, body string")
