"""The tables behind the usual figures; drawing is left to others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.integrate import leaf_order, linkage
from kinspark.operators.products import summed_product

#: Numbers of a block of points and grid cells in a task, and of all grids of sums that a task holds.
_CELLS, _HELD = 500_000, 4_000_000


def top_bottom(df: DataFrame, value: str, n: int, label: str) -> DataFrame:
    """The n rows of highest and the n of lowest value, with ``side``; ties by label."""
    top = df.orderBy(F.col(value).desc(), label).limit(n).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.col(value).asc(), label).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def centroids(coords: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, x, y, n): mean position of each group's nodes."""
    return coords.join(groups, "node").groupBy("grp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def medians(coords: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, x, y): median position of each group's nodes, where a legend's label goes."""
    return coords.join(groups, "node").groupBy("grp").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def group_scatter(coords: DataFrame, groups: DataFrame, most: int = 40) -> DataFrame:
    """(node, x, y, grp) of grouped nodes; more than ``most`` groups are an error."""
    if groups.select("grp").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    return coords.join(groups.where("grp is not null"), "node").select("node", "x", "y", "grp")


def kde_grid(coords: DataFrame, groups: DataFrame, size: int = 100, least: int = 5, margin: float = 0.05) -> DataFrame:
    """(grp, gx, gy, density): Gaussian kernel density of each group of at least ``least`` nodes on one size x size grid.

    The bandwidth is n ** (-1/6) times the group's covariance (Scott's rule).  A task holds one grid of sums a group, to which it
    adds some points at a time, and sends each grid once, a row a column of cells; so no pair of a point and a cell is a row.
    """
    rows = coords.join(groups.where("grp is not null"), "node").select("grp", "x", "y")
    box = [0.0 if v is None else float(v) for v in coords.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()]  # no point, no rows
    dx, dy = (box[1] - box[0]) * margin, (box[3] - box[2]) * margin
    stats = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy")).where(F.col("n") >= least)
    h = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    stats = stats.where(det > 0).select("grp", "n", (F.col("vy") / det / h).alias("pxx"), (F.col("vx") / det / h).alias("pyy"), (-F.col("cxy") / det / h).alias("pxy"), (2 * np.pi * F.sqrt(det) * h).alias("norm"))
    x0, y0 = box[0] - dx, box[2] - dy
    wide, high = (box[1] + dx - x0) / (size - 1), (box[3] + dy - y0) / (size - 1)
    gx, gy = x0 + np.arange(size) * wide, y0 + np.arange(size) * high
    kind = dict(rows.dtypes)["grp"]
    own = rows.where("x is not null and y is not null").join(F.broadcast(stats), "grp").select("grp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "pxx", "pxy", "pyy")

    def run(frames):
        held: dict = {}

        def send():
            for grp, total in held.items():
                yield pd.DataFrame({"grp": [grp] * size, "i": range(size), "sums": list(total)})

        for f in frames:
            for grp, part in f.groupby("grp", sort=False):
                total = held.setdefault(grp, np.zeros((size, size)))
                pxx, pxy, pyy = (float(part[c].iloc[0]) for c in ("pxx", "pxy", "pyy"))
                at = max(1, _CELLS // size**2)
                for lo in range(0, len(part), at):
                    u = gx - part["x"].to_numpy()[lo : lo + at, None]
                    v = gy - part["y"].to_numpy()[lo : lo + at, None]
                    power = (-pxy * u)[:, :, None] * v[:, None, :]
                    power += (-0.5 * pxx * u * u)[:, :, None]
                    power += (-0.5 * pyy * v * v)[:, None, :]
                    total += np.exp(power, out=power).sum(axis=0)
            if len(held) * size**2 > _HELD:
                yield from send()
                held = {}
        yield from send()

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": key[0], "i": key[1], "j": range(size), "total": np.sum(frame["sums"].tolist(), axis=0)})

    sums = own.mapInPandas(run, f"grp {kind}, i int, sums array<double>").groupBy("grp", "i").applyInPandas(add, f"grp {kind}, i int, j int, total double")
    place = lambda start, step, i: F.lit(float(start)) + F.col(i) * F.lit(float(step))
    density = F.col("total") / F.col("norm") / F.col("n")
    return sums.join(F.broadcast(stats.select("grp", "n", "norm")), "grp").select("grp", place(x0, wide, "i").alias("gx"), place(y0, high, "j").alias("gy"), density.alias("density"))


def loss_changes(history: DataFrame) -> DataFrame:
    """(epoch, loss, change): change against the epoch before."""
    return history.withColumn("change", F.col("loss") - F.lag("loss").over(Window.orderBy("epoch")))


def volcano(df: DataFrame, lfc: str, p: str, p_cut: float = 0.05, lfc_cut: float = 1.0, n_label: int = 5, label: str = "gene") -> DataFrame:
    """``df`` with neg_log_p, cls and labelled (the n most significant rows of each side).

    p-values are floored at 1e-300.  Classes: up / down pass both cuts, up_p / down_p the p-value only, lfc_only the effect only.
    """
    sig, big = F.col(p) < p_cut, F.abs(F.col(lfc)) >= lfc_cut
    cls = (
        F.when(sig & big & (F.col(lfc) > 0), "up").when(sig & big, "down").when(sig & (F.col(lfc) > 0), "up_p").when(sig, "down_p").when(big, "lfc_only").otherwise("none")
    )
    out = df.withColumn("neg_log_p", -F.log10(F.greatest(F.col(p), F.lit(1e-300)))).withColumn("cls", cls)
    # At most n rows of each side get a label: they are found by two bounded sorts, not by one ordered window.
    ends = None
    for side in ("up", "down"):
        part = out.where(F.col("cls") == side).orderBy(F.col("neg_log_p").desc(), F.abs(F.col(lfc)).desc(), label).limit(n_label).select(F.col(label).alias("_label"))
        ends = part if ends is None else ends.unionByName(part)
    return out.join(ends.distinct().withColumn("labelled", F.lit(True)), F.col(label) == F.col("_label"), "left").drop("_label").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def min_max(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """``value`` moved to 0 to 1 over all rows; 0 where all are equal."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))).drop("_a", "_b")


def blend_colours(df: DataFrame, a: str, b: str, corners: tuple, clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``df`` with r, g, b: bilinear mix of four corner colours (neither, a, b, both) by the clipped, scaled a and b.

    ``clip`` are the quantiles of each column that become 0 and 1.
    """
    q = df.agg(*[F.percentile(c, p).alias(f"_{c}{i}") for c in (a, b) for i, p in enumerate(clip)])
    rows = df.crossJoin(F.broadcast(q))

    def unit(c: str) -> Column:
        lo, hi = F.col(f"_{c}0"), F.col(f"_{c}1")
        return F.coalesce(F.try_divide(F.greatest(lo, F.least(hi, F.col(c))) - lo, hi - lo), F.lit(0.0))

    u, v = F.col("_u"), F.col("_v")
    rows = rows.withColumn("_u", unit(a)).withColumn("_v", unit(b))
    for i, name in enumerate(("red", "green", "blue")):
        rows = rows.withColumn(name, (1 - u) * (1 - v) * corners[0][i] + u * (1 - v) * corners[1][i] + (1 - u) * v * corners[2][i] + u * v * corners[3][i])
    return rows.withColumn("combined", u + v).drop("_u", "_v", *[f"_{c}{i}" for c in (a, b) for i in range(2)])


def predictors_difference(summary: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """(feature, a, b, difference, side): features whose mean attribution differs most between two responses."""
    x = summary.where(F.col("response") == a).select("feature", F.col("mean_shap").alias("a"))
    y = summary.where(F.col("response") == b).select("feature", F.col("mean_shap").alias("b"))
    return top_bottom(x.join(y, "feature").withColumn("difference", F.col("a") - F.col("b")), "difference", n, "feature")


def dotplot(values: DataFrame, groups: DataFrame, cap: float = 5.0) -> DataFrame:
    """(grp, gene, mean_z, share): mean z-score capped above, and share of positive values, by group; dense rows (node, gene, value)."""
    of = values.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.least(F.lit(cap), F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0)))
    return values.join(of, "gene").withColumn("z", z).join(groups, "node").groupBy("grp", "gene").agg(F.avg("z").alias("mean_z"), F.avg((F.col("value") > 0).cast("double")).alias("share"))


def heatmap_order(values: DataFrame, most: int = 2000) -> list[str]:
    """Columns (names of (row, name, value)) from left to right by average linkage of their Euclidean distances.

    Products of columns are summed where rows lie, distances follow from them; at most ``most`` columns.  Absent values are zeros.
    """
    names = [r[0] for r in values.select("name").distinct().orderBy("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    at = values.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, at int")
    packed = values.join(F.broadcast(at), "name").groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list(F.col("value").cast("double")).alias("x"))
    g = summed_product(packed, "x", "x", len(names), len(names), "at", "at")
    own = np.diag(g)
    d = np.sqrt(np.maximum(own[:, None] + own[None, :] - 2 * g, 0.0))
    np.fill_diagonal(d, 0.0)
    return [names[i] for i in leaf_order(linkage(d, "average"), len(names))] if len(names) > 1 else names


def performance(predictions: DataFrame, validation: bool | None = None) -> DataFrame:
    """(response, n, r): correlation of real and predicted values, on validation rows, training rows, or all."""
    rows = predictions if validation is None else predictions.where(F.col("validation") == validation)
    r = F.try_divide(F.covar_pop("y", "predicted"), F.stddev_pop("y") * F.stddev_pop("predicted"))
    return rows.where("y is not null").groupBy("response").agg(F.count("*").alias("n"), r.alias("r"))


def selected_share(cells: DataFrame, selected: DataFrame, label: str = "clone") -> DataFrame:
    """(clone, n, n_selected, share): how much of each group's members a selection (cell) holds."""
    hit = cells.join(selected.select("cell").distinct().withColumn("hit", F.lit(True)), "cell", "left")
    out = hit.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("clone")).agg(F.count("*").alias("n"), F.count_if(F.col("hit")).alias("n_selected"))
    return out.withColumn("share", F.col("n_selected") / F.col("n"))


def embedding_table(embedding: DataFrame, colours: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(clone, x, y[, colour][, n_cells]) from the first two coordinates of (clone, u)."""
    out = embedding.select("clone", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))
    if colours is not None:
        out = out.join(colours.select("clone", "colour"), "clone", "left")
    return out if sizes is None else out.join(sizes.select("clone", "n_cells"), "clone", "left")
