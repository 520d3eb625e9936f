"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import dropped, kept


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that is reachable, for each node of an edge (a, b).

    Each round replaces a node's neighbours' links by links to the least neighbour; minima are
    aggregated before they are joined, so a node with very many links is split as a skewed join is.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "large")
        dropped(least, now)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = kept(small.distinct(), "small")
        dropped(least, large)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
