"""Connected components of an edge table, distributed, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge to another.

    Alternates two steps until nothing changes: every node hands its smaller neighbours to its
    smallest one, then its larger neighbours to the smallest of all. Each step is a minimum per
    node (combined before the shuffle) and an equi-join; the smallest neighbours are one row per
    node, so a node with very many edges is only a large side of that join, which Spark can
    split. Each step's edges are a stored table, so their size is known to the next one's joins.
    Null ends give no edge; nodes are of one orderable type.
    """
    pairs = stored(_downhill(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()))
    while True:
        # done when each node has one edge, to a node that has none
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
        sides = pairs.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not sides.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v")).distinct())
        roots = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w")
        small = pairs.join(roots, F.col("u") == F.col("w"))
        small = _downhill(small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*"))
        small = stored(small)
        # the smallest neighbour of v, or v itself: v's own edges go down, all others come from above
        low = small.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w")
        large = small.join(low, F.col("v") == F.col("w"), "left").select("u", F.coalesce("least", "v").alias("v"))
        before, pairs = pairs, stored(_downhill(large.union(low.select(F.col("w").alias("u"), F.col("least").alias("v")))))
        discard(before, small)
