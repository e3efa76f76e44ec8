"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate (the least neighbour of a node) and an equi-join
back; edges are cut to a written table after each round, so lost executors
cost one step, and the table of the round before goes. Nothing is collected: rounds end as soon as the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import forget, written


def _at_rest(e: DataFrame) -> bool:
    """Whether the edges are stars: no node with two smaller neighbours, or with smaller and bigger ones."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    n = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return n.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """``node, comp`` for every node that has an edge; ``comp`` is the least node of its component."""
    e = written(spark, edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(),
                name)
    while not _at_rest(e):
        # large star: bigger neighbours of a node move to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: smaller neighbours of a node, and the node, move to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, e = e, written(spark, small.where("u != v").distinct(), name)
        forget(spark, before)
    # at rest every node points to its component's least node
    out = written(spark, e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), name)
    forget(spark, e)
    return out
