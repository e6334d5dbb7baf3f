"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselite.llm._util import discard, materialise, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(row, component) for edges (a, b) of numbers: each node's component is its least node.  Large-star and small-star steps
    alternate until the edges are stars around least nodes, which one look at the nodes tells; each round is written to the
    shared folder, and the round before deleted.  A hub's edges are dealt among many tasks.  Edges with a null end or from a
    node to itself are ignored; repeated edges count once; an empty table has no nodes.  The result is written; ``discard`` deletes it."""
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # every edge leads from a node to a smaller one
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("other")), F.struct(F.col("b").alias("row"), F.col("a").alias("other")))).alias("e")).select("e.*")
        smaller = F.count_if(F.col("other") < F.col("row"))
        least = F.least(F.min("other"), "row")
        nodes = materialise(ends.groupBy("row").agg(least.alias("component"), ((smaller > 1) | (smaller == 1) & (F.count("*") > 1)).alias("open")), "nodes")
        if nodes.filter("open").isEmpty():
            break
        large = spread_join(now, nodes.select(F.col("row").alias("b"), F.col("component").alias("m")), "b", F.col("a"), merge=True).select("a", F.col("m").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        out = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        old, now = now, materialise(out, "edges")
        discard(old, nodes)
    found = materialise(nodes.select("row", "component"), "components")
    discard(now, nodes)
    return found
