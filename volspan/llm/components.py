"""Connected components by contraction to least neighbours, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``a, b`` (long, either order, loops allowed). Returns ``id, component`` (the least id reached) for every id in an edge.

    Each round every vertex goes to the least of its neighbours and itself, then to where that one goes; edges follow their ends, and those that have become loops or repeats
    leave, so a star of any size is one round's work. Labels and edges are written each round; only whether edges are left returns to the driver.
    """
    edges, labels = materialize(edges.select(*_ordered("a", "b")).distinct()), None
    while True:
        ends = edges.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("to"))
        near = materialize(ends.groupBy("id").agg(F.min("to").alias("to")))
        far = near.select(F.col("id").alias("to"), F.col("to").alias("far"))
        goes = materialize(near.join(far, "to").select("id", F.least("to", "far").alias("to")))
        if labels is None:
            labels = goes.select("id", F.col("to").alias("component"))
        else:
            moved = goes.select(F.col("id").alias("component"), "to")
            labels = materialize(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        left = edges.join(goes.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(goes.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(left.filter("x <> y").select(*_ordered("x", "y")).distinct())
        if edges.isEmpty():
            return labels
