"""Connected components of links, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import stored


def _nearest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _unsettled(links: DataFrame) -> int:
    """How many nodes have several smaller neighbours, or smaller and larger ones.

    When each ``u`` has one ``v`` and no ``v`` is a ``u``, every component hangs on its smallest.
    """
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, any order, of one ordered type).

    The root is the smallest node of the component and belongs to the result too. Large-star
    and small-star steps alternate until only stars are left: each node's larger neighbours,
    and then its smaller ones, are linked to its smallest. The number of links never grows,
    and each step's links are written to the shared work folder. A node with very many links
    is one row per task in the aggregation, and Spark splits the join on it.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = stored(links.filter(F.col("a") != F.col("b")).select(*pair).distinct(), "links")
    while _unsettled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to the smallest of u and its neighbours.
        low = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large, "links")
        # Small star: u and its neighbours below go to the smallest neighbour.
        low = _nearest(large)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        now = stored(small.filter(F.col("u") != F.col("v")).distinct(), "links")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
