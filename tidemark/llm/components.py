"""Connected components by hooking and pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _flat(hooks: DataFrame) -> DataFrame:
    """hooks(node, up), up < node: every node with the last node above it. Written."""
    written = None
    while written is None or not written.filter("moved").isEmpty():
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        higher = hooks.select("node", "up").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        higher = materialize(higher, "cc-hooks")
        if written is not None:
            release(written)
        hooks = written = higher
    return written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, component) of every node that has an edge: the smallest node it reaches.

    Each round, every root hooks on the smallest root it has an edge to, hooks are followed to their ends, and edges are
    contracted, so rounds grow with the logarithm of the largest component. Only minima are gathered by key.
    """
    links = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    known = None
    while not links.isEmpty():
        hooks = _flat(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        if known is None:
            known = materialize(hooks.select("node", "up"), "cc-known")
        else:
            moved = known.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
            moved = moved.select("node", F.coalesce("top", "up").alias("up")).unionByName(hooks.select("node", "up").join(known.select("node"), "node", "left_anti"))
            moved = materialize(moved, "cc-known")
            release(known)
            known = moved
        at = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        left = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y"))
        left = materialize(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        release(hooks, links)
        links = left
    release(links)
    if known is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    tops = known.select(F.col("up").alias("node")).distinct().join(known.select("node"), "node", "left_anti").withColumn("up", F.col("node"))
    return known.unionByName(tops).select("node", F.col("up").alias("component"))
