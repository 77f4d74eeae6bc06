"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the least of the node's neighbourhood.

    ``large``: neighbours above the node; else those below it and itself. The least
    neighbour is found by a combining aggregate, and joins the links as a side
    that is unique by node, so a hub's links can be split over tasks.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m")
    )
    joined = near.join(least, near["u"] == least["node"])
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("node").alias("u"), F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns) but the roots.

    Rounds grow with the logarithm of the largest component; each writes its links,
    so lineage stays short. Ended when a round changes nothing.
    """
    a, b = links.columns[:2]
    edges = stage(
        spark,
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(),
        "links",
    )
    seen = None
    while True:
        mark = edges.select(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")
        ).first()
        if mark == seen or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        edges = stage(spark, _star(_star(edges, True), False), "links")
