"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    return (
        both.join(least, F.col("u") == F.col("w")).where("v > u AND v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of every node, and itself, on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    hung = down.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v), root the smallest node it can reach.

    Nodes on no edge, or on edges to themselves only, are left out. Every round is written
    to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select("u", F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
            )
        before = state
        edges = stored(_small_star(_large_star(edges).unionByName(_roots(edges))), "edges")


def _roots(edges: DataFrame) -> DataFrame:
    """Edges from every node to its smallest neighbour, which the large star leaves as they are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v"))
    return least.where("v < u")
