"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from hourgrid.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node that has a neighbour other than itself and is not the root; the
    root is the smallest node of the component.

    Every round rewrites each node's edges to its smallest neighbour.  A node with many neighbours is
    reduced by an aggregate with map-side combine and met again in an equi-join, which adaptive
    execution may split.  Rounds end when the edge table no longer changes; their number grows with the
    logarithm of the component's diameter.
    """
    u, v = edges.columns
    at = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    held, before, i = None, None, 0
    while True:
        seen = Observation()
        at = scratch.save(at.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("key")), f"{name}-{i}")
        if held:
            scratch.drop(held)
        held, i = f"{name}-{i}", i + 1
        now = seen.get
        if not now["n"] or now == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = small.unionByName(below.select("u", F.col("m").alias("v"))).distinct()
