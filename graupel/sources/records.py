"""Records with their children, each one nested row, in one Parquet folder.

A Parquet row is in one file, and files appear whole, so a record never lacks a
part of its children, wherever a run is cut off; the next run appends what is
still missing.  Child tables are views that read their own array alone.

Cases: of records with one key the table keeps what it has, and of new ones any
single one; a null key is an error; null and empty arrays have no children; an
empty frame inserts nothing; columns that the schema lacks are dropped.  One
writer at a time: two that insert one key at once are not told apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.keys import missing


class Records:
    """``schema`` names the columns, arrays of structs for children, and
    ``key`` the column that tells records apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def rows(self, *columns: str) -> DataFrame:
        """The records, of all columns or those named; empty before the first insert."""
        schema = StructType([self.schema[c] for c in columns]) if columns else self.schema
        fs, p = self._hadoop(self.path)
        return self.spark.read.schema(schema).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def children(self, array: str, parent: str) -> DataFrame:
        """The elements of an array as a table; ``parent`` names its column of the record's key."""
        rows = self.rows(self.key, array).select(F.col(self.key).alias(parent), F.explode(array).alias("e"))
        return rows.select(parent, "e.*")

    def insert(self, records: DataFrame, unique: Sequence[str] = ()) -> int:
        """Appends the records whose key isn't there, and returns how many.

        They are landed first, so that what made them runs once, and appended by
        one job.  A value of a ``unique`` column that two records have is an error,
        and then nothing is appended."""
        key = F.coalesce(self.key, F.raise_error(F.lit(f"a record without {self.key}")))
        given = records.withColumn(self.key, key).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema))
        fs, landed = self._hadoop(f"{self.path}_new_{uuid.uuid4().hex}")
        try:
            missing(given.dropDuplicates([self.key]), self.rows(self.key), self.key).write.parquet(landed.toString())
            new = self.spark.read.schema(self.schema).parquet(landed.toString())
            for column in unique:
                names = new.select(column).where(F.col(column).isNotNull())
                both = names.unionByName(self.rows(column).join(names.distinct(), column, "left_semi")).groupBy(column).count().where("count > 1").select(column).first()
                if both:
                    raise ValueError(f"duplicate {column}: {both[0]}")
            saved = new.count()
            if saved:
                new.write.mode("append").parquet(self.path)
            return saved
        finally:
            fs.delete(landed, True)
