"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) as (node, label): the label is the least node of
    the component.  Each round points every node at its least neighbour,
    follows the pointers to their ends and contracts the graph along them; the
    edges left go down by half at least and mostly to none in a few rounds."""
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "graph-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "graph-pointers")
        while True:
            on = to.select(F.col("u").alias("via"), F.col("p").alias("q"))
            away = to.where("p <> u").join(on, F.col("p") == F.col("via")).select("u", "p", "q")
            if away.where("p <> q").isEmpty():
                break
            to = written(to.where("p = u").unionByName(away.select("u", F.col("q").alias("p"))), "graph-pointers")
        labels = to.select(F.col("u").alias("node"), F.col("p").alias("label")) if labels is None else (
            labels.join(to, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label"))
        )
        labels = written(labels, "graph-labels")
        a, b = to.select(F.col("u"), F.col("p").alias("pu")), to.select(F.col("u").alias("w"), F.col("p").alias("pv"))
        edges = written(
            edges.join(a, "u").join(b, F.col("v") == F.col("w")).select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct(), "graph-edges"
        )
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
