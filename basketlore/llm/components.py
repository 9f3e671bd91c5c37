"""Connected components of a graph of pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), "m")
    return linked.union(least.select("u", "m")).select("u", F.col("m").alias("v"))


def components(work: Scratch, pairs: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node of ``pairs`` (a, b) but the smallest itself."""
    a, b = F.col("a"), F.col("b")
    edges = pairs.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = work.write(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return work.same_table(found, edges)
        before = state
        after = work.write(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        work.drop(edges)
        edges = after
