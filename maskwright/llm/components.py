"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialize


def joined(left: DataFrame, right: DataFrame, key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join whose right side is an aggregate by its key. With a hash of the key as a second key both sides are exchanged
    for the join itself, so that Spark can split a hot key of the left side at run time; else it would keep to the aggregate's
    partitions, where one key is one task."""
    own, other = left.withColumn("_h", F.xxhash64(key)), right.withColumn("_k", F.xxhash64(right_key))
    return own.join(other, (F.col("_h") == F.col("_k")) & (F.col(key) == F.col(right_key)), how).drop("_h", "_k")


def _large_star(e: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node around it."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return joined(both.filter("b > a"), least, "a", "u").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ties = joined(down, least.withColumnRenamed("a", "u"), "a", "u").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return ties.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Nodes of the links (columns a, b of one orderable type) with the smallest node of their component as ``root``: columns node, root.

    Rounds grow with the logarithm of the longest chain; each is written in the shared folder, so a lost executor costs one
    round at most. Only two numbers a round come to the driver. Links of a node to itself, and repeated links, change nothing.
    """
    edges = materialize(links.filter("a <> b").select("a", "b").distinct(), name)
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
