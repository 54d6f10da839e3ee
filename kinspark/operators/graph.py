"""Graphs as edge lists (src, dst, weight): smoothing, connectivity, blending, plot edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.sources.store import stored


def smooth(edges: DataFrame, values: DataFrame, n_steps: int = 3) -> DataFrame:
    """(node, name, value) averaged over each node's neighbours and itself, ``n_steps`` times.

    Edges count as present or not (weight > 0); ``values`` must have a row for every node and name.
    """
    hops = edges.where("weight > 0").select("src", "dst").unionByName(values.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    hops = stored(hops, "hops") if n_steps > 1 else hops
    for step in range(n_steps):
        values = hops.join(values, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "name").agg(F.avg("value").alias("value"))
        if step < n_steps - 1:
            values = stored(values, "smoothed")
    return values


def group_connectivity(edges: DataFrame, groups: DataFrame, directed: bool = True) -> DataFrame:
    """(a, b, observed, expected, connectivity) for every pair of groups; ``groups``: (node, grp).

    Directed: edges present against the product of out- and in-degrees over all edges.  Undirected: pairs joined in
    either direction against group sizes.  Where nothing is expected, and without edges at all, it is 0.
    """
    present = edges.where("weight > 0").select("src", "dst").distinct()
    if not directed:
        present = present.unionByName(present.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    own = groups.select("node", "grp")
    seen = present.join(own.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst")
    counts = seen.groupBy("a", "b").agg(F.count("*").alias("observed"))
    sizes = own.groupBy("grp").agg(F.count("*").alias("size"))
    out = counts.groupBy("a").agg(F.sum("observed").alias("out"))
    into = counts.groupBy("b").agg(F.sum("observed").alias("into"))
    total = counts.agg(F.coalesce(F.sum("observed"), F.lit(0)).alias("total"))
    n = own.agg(F.count("*").alias("n"))
    # One row per pair of groups: the matrix that is asked for.
    spine = sizes.select(F.col("grp").alias("a"), F.col("size").alias("size_a")).crossJoin(sizes.select(F.col("grp").alias("b"), F.col("size").alias("size_b")))
    full = spine.join(counts, ["a", "b"], "left").join(out, "a", "left").join(into, "b", "left").join(out.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    if directed:
        expected = F.coalesce(F.try_divide(zero("out") * zero("into"), zero("total")), F.lit(0.0))
    else:
        expected = F.coalesce(F.try_divide(zero("out") * zero("size_b") + zero("size_a") * zero("out_b"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    full = full.select("a", "b", zero("observed").alias("observed"), expected.alias("expected"))
    return full.withColumn("connectivity", F.when(F.col("expected") > 0, F.coalesce(F.try_divide("observed", "expected"), F.lit(0.0))).otherwise(0.0))


def connectivity_matrix(connectivity: DataFrame, value: str = "connectivity") -> DataFrame:
    """The pairs as a table with a row for each group and a column for each group."""
    return connectivity.groupBy("a").pivot("b").agg(F.first(value))


def blend(lineage: DataFrame, graph: DataFrame, alpha: float = 0.2, beta: float = 0.1) -> DataFrame:
    """alpha ** beta * (lineage - graph) + graph over the edges of both; absent edges count as 0."""
    if not 0 <= alpha <= 1 or not 0 <= beta <= 1:
        raise ValueError("alpha and beta must lie in 0 to 1")
    a = lineage.select("src", "dst", F.col("weight").cast("double").alias("l"))
    b = graph.select("src", "dst", F.col("weight").cast("double").alias("c"))
    share = float(alpha) ** float(beta)
    both = a.join(b, ["src", "dst"], "full").select("src", "dst", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("c", F.lit(0.0)).alias("c"))
    return both.select("src", "dst", (F.lit(share) * (F.col("l") - F.col("c")) + F.col("c")).alias("weight"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """A + its transpose."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def is_symmetric(edges: DataFrame, tol: float = 1e-10) -> bool:
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
    off = edges.join(turned, ["src", "dst"], "full").where(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("w2", F.lit(0.0))) > tol)
    return off.isEmpty()


def plot_edges(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """(src, dst, weight, x0, y0, x1, y1); an undirected graph has each pair once, with A + its transpose."""
    own = edges.where("weight > 0")
    if is_symmetric(own):
        own = symmetrise(own).where("src < dst")
    a = coords.select(F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = coords.select(F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return own.join(a, "src").join(b, "dst").select("src", "dst", "weight", "x0", "y0", "x1", "y1")
