"""Long feature tables (obs, gene, value): aggregation by group, layers, masks, centring.

A long table leaves zeros out, so every mean divides by a number of members and never by a number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.groups import NA, labelled

#: Rows of a layer that a task sorts.
_ROWS = 250_000


def choose_source(x: DataFrame, raw: DataFrame | None = None, layers: dict[str, DataFrame] | None = None, layer: str | None = None, use_raw: bool | None = None) -> DataFrame:
    """A layer before raw before x; raw is used by default if there is one and no layer is named."""
    if layer is not None:
        return (layers or {})[layer]
    if use_raw or (use_raw is None and raw is not None):
        if raw is None:
            raise ValueError("there is no raw table")
        return raw
    return x


def group_labels(cells: DataFrame, clones: DataFrame, label: str = "clone", use_col: str | None = None, na: str = NA) -> DataFrame:
    """(cell, grp): a member's group, or with ``use_col`` the category its label names directly or through its group."""
    own = labelled(cells.select("cell", F.col(label).alias("_label")), "_label", na)
    if use_col is None:
        return own.join(clones.select(F.col("clone").alias("_label")), "_label", "left_semi").select("cell", F.col("_label").alias("grp"))
    cats = clones.select(F.col(use_col).cast("string").alias("cat")).where("cat is not null").distinct()
    direct = own.join(cats, own["_label"] == cats["cat"], "left")
    via = clones.select(F.col("clone").alias("_clone"), F.col(use_col).cast("string").alias("via"))
    both = direct.join(via, direct["_label"] == via["_clone"], "left").select("cell", F.coalesce("cat", "via").alias("grp"))
    return both.where("grp is not null")


def transfer(expr: DataFrame, labels: DataFrame, strategy: str = "average", split: DataFrame | None = None) -> DataFrame:
    """(grp, [split,] gene, value): sums or means over members of each group, of each split value if given.

    ``labels``: (cell, grp); ``split``: (cell, split).  Groups whose total is not positive are left out, and so are
    members with a null split.  A mean counts members without a row of the gene as zeros.
    """
    if strategy not in ("average", "sum"):
        raise ValueError(f"unknown strategy {strategy!r}")
    keys, own = ["grp"], labels
    if split is not None:
        keys, own = ["grp", "split"], labels.join(split.where("split is not null"), "cell")
    sums = expr.join(own, "cell").groupBy(*keys, "gene").agg(F.sum("value").alias("total"))
    positive = sums.groupBy("grp").agg(F.sum("total").alias("t")).where("t > 0").select("grp")
    sums = sums.join(positive, "grp", "left_semi")
    if strategy == "sum":
        return sums.withColumnRenamed("total", "value")
    n = own.groupBy(*keys).agg(F.count("*").alias("n"))
    return sums.join(n, keys).select(*keys, "gene", (F.col("total") / F.col("n")).alias("value"))


def split_mask(labels: DataFrame, split: DataFrame) -> DataFrame:
    """(grp, split, has_cells) for every group and split value."""
    seen = labels.join(split.where("split is not null"), "cell").select("grp", "split").distinct()
    spine = labels.select("grp").distinct().crossJoin(split.where("split is not null").select("split").distinct())
    return spine.join(seen.withColumn("hit", F.lit(True)), ["grp", "split"], "left").select("grp", "split", F.coalesce("hit", F.lit(False)).alias("has_cells"))


def missing_rows(values: DataFrame, obs: DataFrame) -> DataFrame:
    """(obs, missing): whether any value of an observation is null or NaN; without rows it is not."""
    bad = values.groupBy("obs").agg(F.bool_or(F.col("value").isNull() | F.isnan("value")).alias("bad"))
    return obs.select("obs").join(bad, "obs", "left").select("obs", F.coalesce("bad", F.lit(False)).alias("missing"))


def stack_layers(layers: dict[str, DataFrame], obs: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(obs, layer, source_obs, gene, value) of all layers, ``layer:obs``, without observations with missing values.

    ``mask`` (obs, layer, has_cells) leaves out what is false or absent in it.  Only observations with missing values are
    gathered, so nothing is counted for the others.
    """
    out, n_obs = None, obs.count()
    for name in sorted(layers):
        # So many partitions that none has much more than some rows, however large the tables are.
        parts = max(obs.sparkSession.sparkContext.defaultParallelism, math.ceil(max(layers[name].count(), n_obs) / _ROWS))
        rows = layers[name].repartition(parts, "obs")
        bad = layers[name].where(F.col("value").isNull() | F.isnan("value")).select("obs").repartition(parts, "obs")
        # Keys in order pack into so few bytes that a table of millions is taken for a small one and sent whole; sorted sides need no such table.
        good = obs.select("obs").repartition(parts, "obs").join(bad.hint("merge"), "obs", "left_anti")
        if mask is not None:
            good = good.join(mask.where((F.col("layer") == name) & F.col("has_cells")).select("obs").hint("merge"), "obs", "left_semi")
        part = rows.join(good.hint("merge"), "obs", "left_semi").select(F.concat(F.lit(f"{name}:"), F.col("obs").cast("string")).alias("obs"), F.lit(name).alias("layer"), F.col("obs").alias("source_obs"), "gene", "value")
        out = part if out is None else out.unionByName(part)
    return out


def densify(expr: DataFrame, obs: DataFrame, key: str = "cell") -> DataFrame:
    """``expr`` with explicit zeros for every observation and gene."""
    spine = obs.select(key).crossJoin(expr.select("gene").distinct())
    return spine.join(expr, [key, "gene"], "left").select(key, "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def regress_categories(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the mean of each category taken off, one key after the other; rows must hold zeros too.

    All means follow from the sums of each combination of categories, which are summed in one pass and are few; rows
    only meet what is to be taken off.  Null is a category of its own.
    """
    kinds = dict(dense.dtypes)
    for key in keys:
        if kinds[key] in ("double", "float"):
            raise ValueError(f"{key} is numeric; categories are wanted")
    if not keys:
        return dense
    sums = dense.groupBy(*keys, "gene").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"), F.lit(0.0).alias("_off"))
    for key in keys:
        by = Window.partitionBy(key, "gene")
        mean = F.try_divide(F.sum(F.col("_s") - F.col("_n") * F.col("_off")).over(by), F.sum("_n").over(by).cast("double"))
        sums = sums.withColumn("_off", F.col("_off") + F.coalesce(mean, F.lit(0.0)))
    off = sums.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "gene")], "_off")
    same = [dense[k].eqNullSafe(off[f"_{k}"]) for k in (*keys, "gene")]
    return dense.join(off, same).withColumn("value", F.col("value") - F.col("_off")).select(*dense.columns)
