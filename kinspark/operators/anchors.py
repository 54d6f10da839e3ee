"""Integration anchors between batches in a shared space (canonical correlation or reciprocal PCA), and correction by them.

Both spaces come from genes x genes products that Spark sums over cells; cells get their coordinates row by row
from a broadcast matrix.  So the number of genes is bounded by the driver, the number of cells by nothing: joins of
cells, neighbours and anchors are merges of shuffled rows, as their tables, packed on disk, look small enough to be broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.integrate import merge_order
from kinspark.operators.knn import knn
from kinspark.operators.products import summed_product
from kinspark.sources.store import stored


def _gram(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of x x' over rows (x)."""
    return summed_product(rows, "x", "x", dim, dim)


def _centred(rows: DataFrame) -> DataFrame:
    """Each batch's vectors minus the batch's mean."""
    mean = rows.select("batch", F.posexplode("x").alias("i", "v")).groupBy("batch", "i").agg(F.avg("v").alias("m"))
    mean = mean.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")).select("batch", F.transform("m", lambda e: e["m"]).alias("m"))
    return rows.join(F.broadcast(mean), "batch").withColumn("x", F.zip_with("x", "m", lambda a, b: a - b)).drop("m")


def _project(rows: DataFrame, matrix: np.ndarray, l2_norm: bool) -> DataFrame:
    """(id, x) times the matrix, rows scaled to norm 1 if wanted."""
    sent = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(frames):
        for f in frames:
            z = np.array(f["x"].tolist(), dtype=float).reshape(-1, len(sent.value)) @ sent.value
            if l2_norm:
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
            yield pd.DataFrame({"id": f["id"], "x": list(z)})

    return stored(rows.select("id", "x").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, x array<double>"), "space")


def _canonical(c1: np.ndarray, c2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that take cells of either batch to the left and right singular vectors of X1 X2' (rows are cells).

    With C = X'X the squares of singular values are the eigenvalues of C1^1/2 C2 C1^1/2.
    """
    value, vector = np.linalg.eigh(c1)
    good = value > 1e-10 * value[-1]
    root, inverse = vector[:, good] * np.sqrt(value[good]), vector[:, good] / np.sqrt(value[good])
    s2, w = np.linalg.eigh(root.T @ c2 @ root)
    keep = np.argsort(-s2)[: min(n, int((s2 > 1e-10 * s2[-1]).sum()))]
    left = inverse @ w[:, keep]
    return left, c1 @ left / np.sqrt(s2[keep])


def _components(c: np.ndarray, n: int) -> np.ndarray:
    value, vector = np.linalg.eigh(c)
    return vector[:, np.argsort(-value)[:n]]


def find_anchors(points: DataFrame, method: str = "cca", n_comps: int = 30, k_anchor: int = 5, k_filter: int | None = 200, k_score: int = 30, max_features: int = 200, l2_norm: bool = True) -> DataFrame:
    """(a, b, batch_a, batch_b, weight) between all pairs of batches of ``points`` (id, batch, x over genes).

    Anchors are mutual ``k_anchor`` neighbours in the shared space.  They are kept if b is among the ``k_filter`` nearest of
    a in the genes that load highest, and weighed by how many of their ``k_score`` neighbours they share, from
    the 1st percentile (0) to the 90th (1).
    """
    if method not in ("cca", "rpca"):
        raise ValueError(f"unknown method {method!r}")
    points = stored(_centred(points.select("id", "batch", "x")), "centred")
    dim = points.select(F.size("x")).first()[0]
    batches = sorted(r[0] for r in points.select("batch").distinct().collect())
    grams = {b: _gram(points.where(F.col("batch") == b), dim) for b in batches}
    out = None
    for i, p in enumerate(batches):
        for q in batches[i + 1 :]:
            a, b = points.where(F.col("batch") == p), points.where(F.col("batch") == q)
            if method == "cca":
                left, right = _canonical(grams[p], grams[q], n_comps)
                za, zb = _project(a, left, l2_norm), _project(b, right, l2_norm)
                spaces = {"ab": (za, zb), "ba": (zb, za), "aa": (za, za), "bb": (zb, zb)}
            else:
                # Neighbours in the other batch are sought in that batch's own components.
                left, right = _components(grams[p], n_comps), _components(grams[q], n_comps)
                ap, aq, bp, bq = _project(a, left, l2_norm), _project(a, right, l2_norm), _project(b, left, l2_norm), _project(b, right, l2_norm)
                spaces = {"ab": (aq, bq), "ba": (bp, ap), "aa": (ap, ap), "bb": (bq, bq)}
            near = {k: stored(knn(x, y, k_score), "near") for k, (x, y) in spaces.items()}
            ab = near["ab"].where(F.col("r") < k_anchor).select(F.col("q").alias("a"), F.col("n").alias("b"))
            ba = near["ba"].where(F.col("r") < k_anchor).select(F.col("n").alias("a"), F.col("q").alias("b"))
            pairs = ab.join(ba.hint("merge"), ["a", "b"])
            if k_filter is not None:
                load = np.abs(left).max(axis=1) + np.abs(right).max(axis=1)
                top = np.argsort(-load, kind="stable")[:max_features]
                genes = np.eye(dim)[:, np.sort(top)]
                close = knn(_project(a, genes, True), _project(b, genes, True), k_filter).select(F.col("q").alias("a"), F.col("n").alias("b"))
                pairs = pairs.join(close, ["a", "b"], "left_semi")
            pairs = stored(pairs, "pairs")
            hood_a = near["ab"].unionByName(near["aa"]).select(F.col("q").alias("a"), "n")
            hood_b = near["ba"].unionByName(near["bb"]).select(F.col("q").alias("b"), "n")
            shared = pairs.join(hood_a.hint("merge"), "a").join(hood_b.hint("merge"), ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("s"))
            scored = pairs.join(shared.hint("merge"), ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
            ends = scored.agg(F.percentile("s", 0.01).alias("lo"), F.percentile("s", 0.9).alias("hi"))
            share = F.coalesce(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0))
            part = scored.crossJoin(F.broadcast(ends)).select("a", "b", F.lit(p).alias("batch_a"), F.lit(q).alias("batch_b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("weight"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least two batches are needed")
    return stored(out, "anchors")


def anchor_graph(anchors: DataFrame) -> DataFrame:
    """Symmetric (src, dst, weight)."""
    one = anchors.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def integrate(points: DataFrame, anchors: DataFrame, k_weight: int = 100, n_comps: int = 30, scale: bool = False, scale_max: float = 10.0) -> DataFrame:
    """``points`` (id, batch, x) with vectors corrected: batches are merged in the order of their anchors' number.

    In each merge the side with fewer cells moves: a cell by the mean of its ``k_weight`` nearest anchors' differences
    (in the side's own components), nearer and better anchors weighing more.  ``scale``: each coordinate to mean 0
    and standard deviation 1, cut at ``scale_max``.
    """
    sizes = {r["batch"]: r["count"] for r in points.groupBy("batch").count().collect()}
    batches = sorted(sizes)
    counts = {frozenset((r.batch_a, r.batch_b)): r["count"] for r in anchors.groupBy("batch_a", "batch_b").count().collect()}
    similarity = np.array([[float(counts.get(frozenset((p, q)), 0)) if p != q else 0.0 for q in batches] for p in batches])
    dim = points.select(F.size("x")).first()[0]
    edges, members = anchor_graph(anchors), {b: [b] for b in batches}
    for p, q, new in merge_order(batches, similarity):
        left, right = members[p], members[q]
        members[new] = left + right
        small, large = (left, right) if sum(map(sizes.get, left)) < sum(map(sizes.get, right)) else (right, left)
        query, ref = points.where(F.col("batch").isin(small)), points.where(F.col("batch").isin(large))
        found = edges.join(query.select(F.col("id").alias("src"), F.col("x").alias("xq")).hint("merge"), "src").join(ref.select(F.col("id").alias("dst"), F.col("x").alias("xr")).hint("merge"), "dst")
        found = stored(found.select(F.monotonically_increasing_id().alias("anchor"), "src", "weight", F.zip_with("xr", "xq", lambda u, v: u - v).alias("shift")), "shifts")
        space = _project(query, _components(_gram(_centred(query.withColumn("batch", F.lit("all"))), dim), n_comps), False)
        at = space.join(found.select(F.col("src").alias("id"), "anchor").hint("merge"), "id").select(F.col("anchor").alias("id"), "x")
        near = knn(space, at, k_weight).join(found.select(F.col("anchor").alias("n"), "weight", "shift"), "n")
        far = F.max("d").over(Window.partitionBy("q"))
        near = near.withColumn("w", 1.0 - F.exp(-(1.0 - F.coalesce(F.try_divide("d", far), F.lit(0.0))) * F.col("weight") / 4.0))
        near = near.withColumn("w", F.coalesce(F.try_divide("w", F.sum("w").over(Window.partitionBy("q"))), F.lit(0.0)))
        move = near.select("q", "w", F.posexplode("shift").alias("i", "v")).groupBy("q", "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        move = move.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).select(F.col("q").alias("id"), F.transform("m", lambda e: e["v"]).alias("m"))
        points = stored(points.join(move.hint("merge"), "id", "left").select("id", "batch", F.when(F.col("m").isNotNull(), F.zip_with("x", "m", lambda u, v: u + v)).otherwise(F.col("x")).alias("x")), "integrated")
    if scale:
        long = points.select("id", "batch", F.posexplode("x").alias("i", "v"))
        by = Window.partitionBy("i")
        z = F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(by), F.stddev_samp("v").over(by)), F.lit(0.0))
        long = long.withColumn("z", F.least(F.lit(scale_max), z))
        points = long.groupBy("id", "batch").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("m")).select("id", "batch", F.transform("m", lambda e: e["z"]).alias("x"))
    return points
