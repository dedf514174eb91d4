"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import BROADCAST_IDS, cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; ``root`` is the least node of its component.

    Each round joins every edge with the least neighbour of its ends, so a hub costs as many rows as it has
    edges. Rounds grow with the log of the longest path. Loops and repeated edges change nothing; null ends
    are left out; no edges give no rows.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = cut(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        # past the bound the small side is stored, so that both sides are plain shuffles, whose hot keys are split
        near = F.broadcast if state[0] <= BROADCAST_IDS else cut
        # every node's least neighbour, itself included
        least = e.select(F.col("v").alias("x"), F.col("v").alias("m")).union(e.select("u", "v")).groupBy("x").agg(F.min("m").alias("m"))
        large = e.join(near(least), F.col("v") == F.col("x")).select("u", F.col("m").alias("v"))
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(near(low), F.col("u") == F.col("x")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        e = cut(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
