"""``python -m graupel QUERY SF_DIR`` runs a registered query and prints it as JSON
lines; ``python -m graupel sync STORE URL`` loads what a store lacks of a paged
catalogue and prints what was saved."""

import os
import sys
import urllib.request
from datetime import datetime, timezone

from pyspark.sql import SparkSession, functions as F

from graupel.operators import passes
from graupel.plans import catalogue
from graupel.sources import store


def fetch(url: str) -> tuple[int, str]:
    with urllib.request.urlopen(url) as answer:
        return answer.status, answer.read().decode()


def synchronise(spark: SparkSession, root: str, base: str, fetch=fetch, now: datetime | None = None, mode: str | None = None):
    """The answer of one synchronisation, which only the SEED mode has."""
    named = spark.range(1).select(passes.mode(F.lit(mode)).alias("mode")).first()["mode"]
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    passes.gated(spark.range(1), named, "SEED")
    return store.saved(store.Store(spark, root), base, fetch, now)


def main(args: list[str]) -> int:
    syncs = len(args) == 3 and args[0] == "sync"
    if not syncs and (len(args) != 2 or args[0] not in catalogue.queries()):
        print(f"usage: python -m graupel QUERY SF_DIR | sync STORE URL\nqueries: {' '.join(sorted(catalogue.queries()))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = synchronise(spark, args[1], args[2], mode=os.environ.get("MODE", "SEED")) if syncs else catalogue.queries()[args[0]](spark, args[1])
    for line in found.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
