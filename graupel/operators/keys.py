"""Keys: what is missing, what comes first, how far they reach without a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def missing(candidates: DataFrame, existing: DataFrame, *on: str) -> DataFrame:
    """Candidates whose key isn't among the existing ones."""
    return candidates.join(existing.select(*on).distinct(), [*on], "left_anti")


def present(candidates: DataFrame, existing: DataFrame, *on: str) -> DataFrame:
    return candidates.join(existing.select(*on).distinct(), [*on], "left_semi")


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def best_of_each(df: DataFrame, key: list[str], score: str, *ties: Column) -> DataFrame:
    """The row of the highest score of each key; ties in the given order.  Rows
    without a score don't take part."""
    return first_of_each(df.where(F.col(score).isNotNull()), key, [F.desc(score), *ties])


def contiguous_prefix(df: DataFrame, key: str) -> DataFrame:
    """One row: how many of 1, 2, 3, ... are there before the first gap.  The
    end of the prefix is the least key whose successor is missing, found by an
    anti-join and not by a window over all rows."""
    ids = df.select(F.col(key).cast("long").alias("id")).where("id >= 1").distinct()
    ends = ids.join(ids.select((F.col("id") - 1).alias("id")), "id", "left_anti")
    return ends.agg(F.min("id").alias("end")).crossJoin(ids.agg(F.min("id").alias("start"))).select(F.when(F.col("start") == 1, F.col("end")).otherwise(0).alias("prefix"))


def after_prefix(df: DataFrame, key: str, prefix: int, total: int) -> DataFrame:
    """Rows with prefix < key <= total, the first of each key, in key order."""
    return df.where((F.col(key) > prefix) & (F.col(key) <= total)).dropDuplicates([key]).orderBy(key)


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is in a list; none for the empty list."""
    return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))


def point(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def first_available(preferred: Column, available: Column) -> Column:
    """The first preferred value that is available, null if none is."""
    return F.get(F.filter(preferred, lambda p: F.array_contains(available, p)), F.lit(0))


def dominant(df: DataFrame, group: list[str], value: str, priority: list[str]) -> DataFrame:
    """The most frequent value of each group; ties by a list of priorities."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(value))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return first_of_each(counts, group, [F.desc("n"), place.asc()])
