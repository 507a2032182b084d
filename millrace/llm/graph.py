"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def _cut(edges: DataFrame, what: str) -> tuple[DataFrame, bool]:
    """The edges (a, b), checkpointed, and whether ``what`` holds for any row; the same job tells."""
    seen = Observation()
    cut = cut_lineage(edges.observe(seen, F.count_if(F.expr(what)).alias("n")))
    return cut.select("a", "b"), bool(seen.get["n"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each linked node with the smallest node it reaches.

    ``edges`` has two columns of one orderable type, named a and b; loops and
    repeats are allowed, nulls are dropped, no links give no rows. A round takes
    two shuffles, one for each star, and ends in a checkpoint, so a lost executor
    never reaches back beyond it. The last round moves no edge.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, moved = _cut(ends.distinct(), "true")
    by_node = Window.partitionBy("a")
    while moved:
        # All links of a node go to its smallest neighbour, or to itself if it is smaller.
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        large = both.withColumn("m", F.least(F.min("b").over(by_node), "a")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        # Then a node keeps its smallest neighbour, and its other smaller ones are linked to that.
        once = large.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved"))
        small = once.withColumn("m", F.min("b").over(by_node)).withColumn("other", F.col("b") > F.col("m"))
        node = F.when(F.col("other"), F.col("b")).otherwise(F.col("a"))
        edges, moved = _cut(small.select(node.alias("a"), F.col("m").alias("b"), "moved", "other"), "moved or other")
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return linked.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
