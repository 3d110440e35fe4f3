"""Transitive closure to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import stage


def reachable(edges: DataFrame, a: str, b: str, start: DataFrame, node: str, max_rounds: int = 1000) -> DataFrame:
    """(node, steps): what can be reached from the start nodes, with the least number of steps; only the frontier is joined in each round."""
    links = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null").distinct()
    seen = stage(start.select(node).where(F.col(node).isNotNull()).distinct().withColumn("steps", F.lit(0)), "closure")
    frontier = seen
    for n in range(1, max_rounds + 1):
        found = frontier.join(links, frontier[node] == links["_a"]).select(F.col("_b").alias(node)).distinct().join(seen.select(node), node, "left_anti")
        frontier = stage(found.withColumn("steps", F.lit(n)), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"the closure has not settled after {max_rounds} rounds")
    return seen
