"""Recognised text and detected rectangles as tables: candidates of several
passes, their union, and the choice among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g, scores as s
from .keys import best_of_each

# Candidates kept of an observation, and rectangles of an image.
CANDIDATES, RECTANGLES = 10, 8


def recognised(raw: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Observations with candidates (array<struct<text, confidence>>), the
    first ten of each; text and confidence are those of the first.  An
    observation without candidates is dropped."""
    top = F.slice(F.col(candidates), 1, CANDIDATES)
    rows = raw.where(F.size(candidates) > 0).withColumn(candidates, top)
    return rows.withColumn("text", F.col(candidates)[0]["text"]).withColumn("confidence", F.col(candidates)[0]["confidence"])


def rectangles(raw: DataFrame, image: str, order: str, confidence: str = "confidence") -> DataFrame:
    """Detected rectangles of sufficient confidence, the first eight of each image."""
    rows = raw.where(F.col(confidence) >= s.MIN_CONFIDENCE)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(image).orderBy(order))).where(F.col("__n") <= RECTANGLES).drop("__n")


def flattened(observations: DataFrame, region: Column | None = None, candidates: str = "candidates", box: str = "box") -> DataFrame:
    """One row per candidate of each observation: text, confidence and the
    observation's box, in the frame where a pass has a region; ``nth`` is the
    candidate's place."""
    keep = [c for c in observations.columns if c not in (candidates, box, "text", "confidence")]
    where = F.col(box) if region is None else F.when(region.isNull(), F.col(box)).otherwise(g.from_region(F.col(box), region))
    rows = observations.select(*keep, where.alias(box), F.posexplode(candidates).alias("nth", "c"))
    return rows.select(*keep, "nth", "c.text", "c.confidence", box)


def concatenated(passes: list[DataFrame], ordinal: str = "pass") -> DataFrame:
    """Rows of several passes, duplicates kept, with the place of their pass."""
    return reduce(DataFrame.unionByName, (rows.withColumn(ordinal, F.lit(i)) for i, rows in enumerate(passes)))


def with_fallback(primary: DataFrame, fallback: DataFrame, image: str, *order: str) -> DataFrame:
    """Primary and fallback candidates with ids from 0, the fallback's
    continuing behind the primary ones of the image."""
    both = primary.withColumn("source", F.lit("primary")).unionByName(fallback.withColumn("source", F.lit("fallback")))
    return both.withColumn("id", F.row_number().over(Window.partitionBy(image).orderBy(F.col("source").desc(), *order)) - 1)


def selected(candidates: DataFrame, image: str, score: str = "score", valid: str = "valid") -> DataFrame:
    """The valid candidate of the highest score of each image, all columns, so
    that a selection is found among the candidates again by image and id."""
    return best_of_each(candidates.where(valid), [image], score, F.asc("id"))
