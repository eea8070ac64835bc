"""Connected components of a link table, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node reachable from each linked node: columns ``node`` and ``component``.

    Alternating large-star and small-star steps: every node is tied to the least
    of its neighbours until nothing changes, in a number of rounds that grows with the
    logarithm of the longest path. The least neighbour is an aggregate (combined
    before the shuffle) that is joined back, so a node with very many links is
    split like any skewed join key. Each round is written to the shared folder. Self
    links, null ends and repeated links have no effect; no links give no rows.
    """
    pairs = links.select(F.least(left, right).alias("v"), F.greatest(left, right).alias("u")).where("v < u").distinct()
    edges, seen = cut(pairs, "components"), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ties = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut(ties.where("v < u").distinct(), "components")
        drop(edges)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
