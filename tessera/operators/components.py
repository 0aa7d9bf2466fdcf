"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.lineage import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of ids to (id, component_id), one row for each id that has an edge; the component's smallest id names it.

    A node's smallest neighbour is found with map-side combination and joined back, so a node with very many neighbours
    is a skewed join that adaptive execution splits; no neighbour list is gathered. Each step is written to the
    checkpoint folder; the driver sees a count and a sum. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())  # every a has smaller b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = cut(small.select(F.greatest("e.b", "e.m").alias("a"), F.least("e.b", "e.m").alias("b")).where("a <> b").distinct())
    return edges.groupBy("a").agg(F.min("b").alias("component_id")).select(F.col("a").alias("id"), "component_id").unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
