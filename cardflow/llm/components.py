"""Connected components of an edge table by large and small stars, with lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.sources.store import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (columns a, b: long).

    Each round links every larger neighbour, then every smaller one, to a node's smallest neighbour. A
    node's neighbours are only aggregated to their minimum and joined, never gathered. Rounds grow with the
    logarithm of the longest path.
    """
    links = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    before = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m"), "a")
        links = materialize(
            small.select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionAll(links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node")))
