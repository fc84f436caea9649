"""Connected components by alternating star contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop_table, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: bigint) reaches.

    Large-star: every node hands its larger neighbours to the smallest node it knows; small-star does so
    for the smaller ones. Both take a minimum per node, which combines before the shuffle, and one join that
    Spark can split, so a hub with most of the nodes stays spread. Each round is written and read again.
    Nodes without edges, and edges with a null end, do not appear in the result.
    """
    edge = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edge.select("u", "v").unionAll(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edge)
        edge = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    leaves = edge.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = edge.select(F.col("v").alias("node")).distinct().join(edge.select(F.col("u").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("root"))
    return leaves.unionAll(roots)
