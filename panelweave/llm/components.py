"""Connected components of a link table, by alternating stars.

Each round is two minimum aggregations with map-side partial results and two
equi-joins, so a node with a third of all links costs one row per task in the
aggregation and can be split by the planner in the join. Rounds are written to the
work folder: lineage stays short, a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs to ``(node, root)``; the root is the smallest node and is left out as a node."""
    u, v = F.col("u"), F.col("v")
    edges = links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(u.alias("node"), v.alias("root"))
        before = now
        edges = materialize(_small_star(_large_star(edges)), "links", now[0])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return edges.join(least, "u").select(pair.alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
