"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Rounds of large and small stars: each node's neighbours are tied to the smallest of them, which at least halves the
    depth of a tree. Every round is two shuffles of the links that are left and is written to the shared folder. A node
    with a third of all links costs one combined row per task for its smallest neighbour; only two sums reach the driver.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links, before = stored(links, "links"), None
    while True:
        links = stored(_star(_star(links, larger=True), larger=False), "links")
        sums = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Ties the larger (or the smaller) neighbours of each node to the smallest of its neighbours and itself."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    back = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    seen = both.union(back) if larger else back
    lowest = seen.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    joined = seen.join(lowest, "node")
    if larger:
        tied = joined.where("other > node").select(F.col("low").alias("a"), F.col("other").alias("b"))
    else:
        tied = joined.select(F.col("low").alias("a"), F.col("other").alias("b")).union(lowest.select(F.col("low").alias("a"), F.col("node").alias("b")))
    return tied.where("a < b").distinct()
