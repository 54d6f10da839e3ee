"""Batch integration: mutual nearest neighbours, merge order, affine alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.knn import knn
from kinspark.operators.products import summed_product
from kinspark.sources.store import stored


def mutual_pairs(a: DataFrame, b: DataFrame, k: int = 10, k_trim: int = 3, metric: str = "euclidean") -> DataFrame:
    """(a, b, rank_sum, weight): mutual k nearest rows of a and b (id, x), the best ``k_trim`` from each side's view.

    The weight is 1 - rank_sum / (2 (k - 1)), 1 if k is 1; k is no more than either side has.
    """
    ab = knn(a, b, k, metric).select(F.col("q").alias("a"), F.col("n").alias("b"), F.col("r").alias("ra"))
    ba = knn(b, a, k, metric).select(F.col("q").alias("b"), F.col("n").alias("a"), F.col("r").alias("rb"))
    both = ab.join(ba, ["a", "b"]).withColumn("rank_sum", F.col("ra") + F.col("rb"))
    weight = F.lit(1.0) if k <= 1 else 1.0 - F.col("rank_sum") / F.lit(2.0 * (k - 1))
    both = both.withColumn("weight", weight)
    from_a = F.row_number().over(Window.partitionBy("a").orderBy("rank_sum", "ra", "b"))
    from_b = F.row_number().over(Window.partitionBy("b").orderBy("rank_sum", "rb", "a"))
    return both.withColumn("pa", from_a).withColumn("pb", from_b).where((F.col("pa") <= k_trim) | (F.col("pb") <= k_trim)).select("a", "b", "rank_sum", "weight")


def find_mnn(points: DataFrame, k: int = 10, k_trim: int = 3, metric: str = "euclidean", least: int = 3) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Symmetric graph (src, dst, weight) over all pairs of batches of ``points`` (id, batch, x), and the merge order.

    Every merge of the order needs ``least`` pairs, else it is an error.
    """
    batches = sorted(r[0] for r in points.where("batch is not null").select("batch").distinct().collect())
    edges = None
    for i, p in enumerate(batches):
        for q in batches[i + 1 :]:
            one = mutual_pairs(points.where(F.col("batch") == p).select("id", "x"), points.where(F.col("batch") == q).select("id", "x"), k, k_trim, metric)
            edges = one if edges is None else edges.unionByName(one)
    if edges is None:
        raise ValueError("at least two batches are needed")
    edges = stored(edges.groupBy("a", "b").agg(F.max("weight").alias("weight")), "mnn")
    graph = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    similarity = batch_similarity(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), points, counts=True)
    table = {frozenset((r.batch_a, r.batch_b)): r.value for r in similarity.collect()}
    matrix = np.array([[table.get(frozenset((p, q)), 0.0) if p != q else 0.0 for q in batches] for p in batches])
    order = merge_order(batches, matrix)
    members = {b: [b] for b in batches}
    for p, q, new in order:
        if sum(table.get(frozenset((x, y)), 0) for x in members[p] for y in members[q]) < least:
            raise ValueError(f"under {least} mutual neighbours between {p} and {q}")
        members[new] = members[p] + members[q]
    return graph, order


def batch_similarity(edges: DataFrame, points: DataFrame, counts: bool = False) -> DataFrame:
    """(batch_a, batch_b, value), batch_a < batch_b: sum of edge weights, or number of edges."""
    own = points.select("id", "batch")
    seen = edges.join(own.select(F.col("id").alias("src"), F.col("batch").alias("p")), "src").join(own.select(F.col("id").alias("dst"), F.col("batch").alias("q")), "dst").where("p <> q")
    value = F.count("*").cast("double") if counts else F.sum("weight")
    return seen.groupBy(F.least("p", "q").alias("batch_a"), F.greatest("p", "q").alias("batch_b")).agg(value.alias("value"))


def linkage(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float, int]]:
    """Agglomerative merges (i, j, height, size); cluster n + t is that of merge t.  Ties go to the lower numbers.

    Each cluster knows its nearest one of higher number.  A merge updates one row of distances and looks anew only for clusters
    whose nearest one went, so the work grows with the square of n in practice, and memory is one matrix.
    """
    if method not in ("ward", "average"):
        raise ValueError(f"unknown linkage {method!r}")
    n = len(distance)
    d, number, size, alive = np.array(distance, dtype=float), np.arange(n), np.ones(n, np.int64), np.ones(n, bool)
    near, least, out = np.full(n, -1), np.full(n, np.inf), []

    def seek(s: int) -> None:
        others = np.flatnonzero(alive & (number > number[s]))
        near[s], least[s] = -1, np.inf
        if len(others):
            least[s] = d[s, others].min()
            ties = others[d[s, others] == least[s]]
            near[s] = ties[number[ties].argmin()]

    for s in range(n):
        seek(s)
    for new in range(n, 2 * n - 1):
        rows = np.flatnonzero(alive)
        height = float(least[rows].min())
        ties = rows[least[rows] == height]
        i = ties[number[ties].argmin()]
        j = near[i]
        out.append((int(number[i]), int(number[j]), height, int(size[i] + size[j])))
        rest = rows[(rows != i) & (rows != j)]
        a, b, si, sj, sm = d[i, rest], d[j, rest], size[i], size[j], size[rest]
        if method == "ward":
            v = np.sqrt(np.maximum(0.0, ((si + sm) * a * a + (sj + sm) * b * b - sm * height * height) / (si + sj + sm)))
        else:
            v = (si * a + sj * b) / (si + sj)
        # The union takes j's row; its number is the highest, so it is nobody's nearest by a tie.
        alive[i], number[j], size[j], near[j], least[j] = False, new, si + sj, -1, np.inf
        d[j, rest] = d[rest, j] = v
        lost = (near[rest] == i) | (near[rest] == j)
        closer = rest[~lost & (v < least[rest])]
        near[closer], least[closer] = j, d[closer, j]
        for s in rest[lost]:
            seek(s)
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right, the lower-numbered cluster of each merge first."""
    leaves = {i: [i] for i in range(n)}
    for t, (i, j, _, _) in enumerate(merges):
        leaves[n + t] = leaves[i] + leaves[j]
    return leaves[max(leaves)]


def merge_order(names: list[str], similarity: np.ndarray) -> list[tuple[str, str, str]]:
    """(left, right, name of the union) by Ward linkage of max - similarity."""
    distance = similarity.max() - similarity
    label = dict(enumerate(names))
    out = []
    for t, (i, j, _, _) in enumerate(linkage(distance)):
        label[len(names) + t] = f"({label[i]}+{label[j]})"
        out.append((label[i], label[j], label[len(names) + t]))
    return out


def write_order(order: list[tuple[str, str, str]]) -> str:
    """Merges as text: ``[a] + [b] = [(a+b)];`` one after the other."""
    return " ".join(f"[{a}] + [{b}] = [{c}];" for a, b, c in order)


def read_order(text: str) -> list[tuple[str, str, str]]:
    import re

    return re.findall(r"\[([^\]]*)\] \+ \[([^\]]*)\] = \[([^\]]*)\];", text)


def _affine(pairs: DataFrame, dim: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares (x, 1) M = y from the sums of products over all pairs (x, y, weight)."""
    w = F.col("weight") if weighted else F.lit(1.0)
    one = F.concat("x", F.array(F.lit(1.0)))
    rows = pairs.select(F.transform(one, lambda v: v * w.cast("double")).alias("wa"), F.concat(one, "y").alias("ay"))
    both = summed_product(rows, "wa", "ay", dim + 1, 2 * dim + 1)
    g, c = both[:, : dim + 1], both[:, dim + 1 :]
    m = np.linalg.lstsq(g, c, rcond=None)[0]
    return m[:-1], m[-1]


def align(points: DataFrame, graph: DataFrame, order: list[tuple[str, str, str]], weighted: bool = True) -> DataFrame:
    """``points`` (id, batch, x) with x moved: for each merge the side with fewer rows is mapped onto the other."""
    members: dict[str, list[str]] = {}
    sizes = {r["batch"]: r["count"] for r in points.groupBy("batch").count().collect()}
    dim = points.select(F.size("x")).first()[0]
    for a, b, new in order:
        left, right = members.get(a, [a]), members.get(b, [b])
        members[new] = left + right
        small, large = (left, right) if sum(map(sizes.get, left)) < sum(map(sizes.get, right)) else (right, left)
        s = points.where(F.col("batch").isin(small)).select(F.col("id").alias("src"), F.col("x"))
        t = points.where(F.col("batch").isin(large)).select(F.col("id").alias("dst"), F.col("x").alias("y"))
        m, shift = _affine(graph.join(s, "src").join(t, "dst").select("x", "y", "weight"), dim, weighted)
        columns = F.array(*[F.array(*[F.lit(float(v)) for v in m[:, j]]) for j in range(dim)])
        dot = lambda col: F.aggregate(F.zip_with("x", col, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        moved = F.zip_with(F.transform(columns, dot), F.array(*[F.lit(float(v)) for v in shift]), lambda p, q: p + q)
        points = stored(points.withColumn("x", F.when(F.col("batch").isin(small), moved).otherwise(F.col("x"))), "aligned")
    return points
