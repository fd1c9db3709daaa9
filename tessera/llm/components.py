"""Connected components of a large graph by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (``a``, ``b``).

    Alternates two steps until all that is left are stars: every node links its larger neighbours,
    then its smaller ones, to the smallest of them.  The minima are written tables, so
    the joins have shuffles of their own and adaptive execution splits the edges of a hub.
    An empty graph gives no row.
    """
    links = scratch.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), "links",
    )
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(
            both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "large-low"
        )
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = scratch.write(large.where("u <> v").distinct(), "large-star")
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("low")), "small-low")
        small = large.join(low, "u").where("v <> low")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            low.select("u", F.col("low").alias("v"))
        )
        links = scratch.write(small.distinct(), "small-star")
        if _stars(links):
            break
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _stars(links: DataFrame) -> bool:
    """Whether no node has two links downwards, or links both ways."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        links.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    ends = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()
