"""Connected components of an edge table, by alternating large and small stars.

Each round is two shuffles of the edges; a vertex's neighbours are never gathered:
minima are aggregated map-side and joined back, so a hub with a third of all edges
is split like any skewed join.  The edges of each round are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import settle

#: Stars converge in a number of rounds that grows with the logarithm of the longest path.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b: longs); component is the least vertex reachable."""
    links = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    for _ in range(MOST_ROUNDS):
        # Large star: each vertex passes the least of its neighbourhood to its larger neighbours.
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        # Settled, so that both sides of the join are shuffled by it and a hub's rows can be split.
        least = settle(least.select("x", F.least("x", "m").alias("m")))
        large = links.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        # Small star: each vertex links its least neighbour with its other smaller ones.
        large = settle(large)
        low = settle(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
        joined = large.join(low, F.col("u") == F.col("x"))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = settle(small.select("e.u", "e.v").where("u <> v").distinct())
        changed = after.join(links, ["u", "v"], "left_anti").unionAll(links.join(after, ["u", "v"], "left_anti"))
        links, done = after, changed.isEmpty()
        if done:
            break
    else:
        raise RuntimeError(f"components haven't settled in {MOST_ROUNDS} rounds")
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(
        links.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
