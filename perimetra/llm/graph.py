"""Connected components of a large graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import settled


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)`, the smallest node of each component, for the nodes of `edges(a long, b long)`.

    Every node hangs itself and its larger neighbours on its smallest neighbour, then its smaller neighbours on the smallest of
    them, in turn until nothing changes: about log(n) rounds whatever the shape of the graph. Minimums are taken by partial
    aggregates and joined back, so that a node with very many neighbours needs no task of its own. Loops and repeated edges
    do no harm; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    now = settled(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # larger neighbours of each node go to the least of its neighbourhood
        around = _both(now)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # smaller neighbours of each node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
