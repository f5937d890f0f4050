"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialise


def _star(links: DataFrame) -> DataFrame:
    """(node, hub): every node with the least node next to it or itself."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    ``links`` has columns a and b of one integer type, in any direction and with any repetitions.  Each round lets every
    node pass its larger, then its smaller neighbours on to its least one, which keeps the components and ends in stars
    after a number of rounds logarithmic in practice.  A hub's links are joined to its row, never gathered.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hubs = _star(both)
        large = both.where("b > a").join(hubs, "a").select(F.col("b").alias("a"), F.col("hub").alias("b")).where("a <> b")
        large = materialise(large.distinct(), "large-star")
        lower = _star(large)  # a > b in every row
        joined = large.join(lower, "a")
        small = joined.select("b", "hub").where("b <> hub").toDF("a", "b").union(lower.toDF("a", "b"))
        after = materialise(small.where("a <> b").distinct(), "small-star")
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            return after.toDF("node", "component").union(after.select(F.col("b"), F.col("b")).distinct())
        edges = after
