"""Connected components of an edge list, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import forget, made_of, stored


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; component is the least node of its component.

    Alternating large-star and small-star steps: edges (node, smaller node) are rewired to the least neighbour
    until each node points at its component's least one.  Rounds grow with the logarithm of a component's
    size.  Each round is written to the shared folder, so lineage stays short and lost tasks are repeated from there;
    ``forget`` deletes the last one once the result has been used.
    """
    current = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            least = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return made_of(current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least), current)
        before = state
        # Large star: each node tells its larger neighbours of the least among itself and its neighbours.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node tells its smaller neighbours, and itself, of the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "edges")
        forget(current)
        current = after
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
