"""Connected components of an edge table: smallest reachable id, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, shuffled, written


def ordered(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> id, component for every id that an edge between different ids names.

    Each round points every id to the smallest of itself and its neighbours
    and from there to where that one points, replaces the ends of all edges by
    what they point to, and drops the edges whose ends agree: what a star holds
    is gone after one round, and chains shorten geometrically.  Rounds are
    tables in the shared folder; hot ids are combined on the map side before
    they are shuffled.
    """
    live, labels = shuffled(written(ordered(edges), "edges")), None
    while labels is None or not live.isEmpty():
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shuffled(written(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "least"))
        further = least.select(F.col("id").alias("to"), F.col("to").alias("further"))
        up = shuffled(written(least.join(further, "to").select("id", F.col("further").alias("up")), "up"))
        at = lambda name: up.select(F.col("id").alias(name), F.col("up").alias(f"{name}_up"))  # noqa: E731, B023
        left = shuffled(written(ordered(live.join(at("a"), "a").join(at("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))), "edges"))
        if labels is None:
            after = shuffled(written(up.withColumnRenamed("up", "component"), "labels"))
        else:
            after = shuffled(written(labels.join(at("component"), "component", "left").select("id", F.coalesce("component_up", "component").alias("component")), "labels"))
            drop(labels)
        drop(live, least, up)
        live, labels = left, after
    drop(live)
    return labels
