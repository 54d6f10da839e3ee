"""Groups ("clones") of members ("cells"): sizes, composition, labels, annotation.

A member whose label is null or the sentinel ``na`` belongs to no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NA = "NA"


def labelled(cells: DataFrame, label: str = "clone", na: str = NA) -> DataFrame:
    return cells.where(F.col(label).isNotNull() & (F.col(label) != na))


def group_sizes(cells: DataFrame, label: str = "clone", min_size: int = 3, na: str = NA) -> DataFrame:
    """(clone, n_cells) of the groups with at least ``min_size`` members."""
    sizes = labelled(cells, label, na).groupBy(F.col(label).alias("clone")).agg(F.count("*").alias("n_cells"))
    return sizes.where(F.col("n_cells") >= min_size)


def composition(cells: DataFrame, clones: DataFrame, fate: str | None, label: str = "clone") -> DataFrame:
    """(clone, fate, n, prop) with a row for every clone and fate, zeros included.

    Fates are the non-null values among members of ``clones``; a proportion is 0 where a group has no fate at all.
    Without ``fate`` each group has the single fate "None" with zeros.
    """
    if fate is None:
        return clones.select("clone", F.lit("None").alias("fate"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("prop"))
    counts = (
        cells.where(F.col(fate).isNotNull())
        .select(F.col(label).alias("clone"), F.col(fate).cast("string").alias("fate"))
        .join(clones.select("clone"), "clone", "left_semi")
        .groupBy("clone", "fate")
        .agg(F.count("*").alias("n"))
    )
    spine = clones.select("clone").crossJoin(counts.select("fate").distinct())
    dense = spine.join(counts, ["clone", "fate"], "left").select("clone", "fate", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("clone"))
    return dense.withColumn("prop", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)))


def group_table(cells: DataFrame, fate: str | None = None, label: str = "clone", min_size: int = 3, na: str = NA) -> DataFrame:
    """(clone, n_cells, n_fates).  ``n_cells`` counts members with a null fate too.  No group at all is an error."""
    sizes = group_sizes(cells, label, min_size, na)
    if sizes.isEmpty():
        raise ValueError(f"no group has {min_size} members")
    fates = composition(cells, sizes, fate, label).groupBy("clone").agg(F.count_if(F.col("prop") > 0).alias("n_fates"))
    return sizes.join(fates, "clone", "left").withColumn("n_fates", F.coalesce("n_fates", F.lit(0)))


def fate_table(comp: DataFrame) -> DataFrame:
    """(fate, n_clones): in how many groups each fate occurs."""
    return comp.groupBy("fate").agg(F.count_if(F.col("prop") > 0).alias("n_clones"))


def unique_labels(cells: DataFrame, label_cols: list[str], na: str = NA, out: str = "clone") -> DataFrame:
    """One row for each label of a member, ``<column>_<label>``; members without any label keep one row with ``na``."""
    each = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != na), F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))) for c in label_cols]
    kept = F.filter(F.array(*each), lambda x: x.isNotNull())
    return cells.withColumn(out, F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(na)))))


def annotate_cells(cells: DataFrame, clones: DataFrame, column: str, label: str = "clone", na: str = NA, out: str | None = None) -> DataFrame:
    """Each member gets its group's value; members of no known group get ``na``, a null of a known group stays."""
    side = clones.select(F.col("clone").alias("_clone"), F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    joined = cells.join(side, F.col(label) == F.col("_clone"), "left")
    return joined.withColumn(out or f"group_{column}", F.when(F.col("_hit"), F.col("_value").cast("string")).otherwise(F.lit(na))).drop("_clone", "_value", "_hit")


def annotate_clones(cells: DataFrame, clones: DataFrame, column: str, label: str = "clone", out: str | None = None) -> DataFrame:
    """Each group gets the one non-null value of its members; a group with two different ones is an error."""
    found = cells.groupBy(F.col(label).alias("clone")).agg(F.min(column).alias("_low"), F.max(column).alias("_high")).join(clones.select("clone"), "clone", "left_semi")
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").isNull(), F.col("_low")).otherwise(F.raise_error(F.concat(F.lit("more than one value in group "), F.col("clone"))))
    return clones.join(found.select("clone", one.alias(out or f"gex_{column}")), "clone", "left")


def size_histogram(clones: DataFrame) -> DataFrame:
    """(n_cells, n_clones, n_at_least): how many groups have a size, and how many have it or more."""
    counts = clones.groupBy("n_cells").agg(F.count("*").alias("n_clones"))
    # One row per distinct size goes through the ordered window.
    return counts.withColumn("n_at_least", F.sum("n_clones").over(Window.orderBy(F.col("n_cells").desc())))


def nesting(cells: DataFrame, early: str, late: str, min_early: int = 1, min_late: int = 1, na: str = NA) -> DataFrame:
    """For each pair of an early and a late group that share members: members of both, of the early one only, of the late one only."""
    own = cells.select(F.col(early).cast("string").alias("early"), F.col(late).cast("string").alias("late"))
    e = labelled(own, "early", na).groupBy("early").agg(F.count("*").alias("n_early")).where(F.col("n_early") >= min_early)
    x = labelled(own, "late", na).groupBy("late").agg(F.count("*").alias("n_late")).where(F.col("n_late") >= min_late)
    both = labelled(labelled(own, "early", na), "late", na).groupBy("early", "late").agg(F.count("*").alias("n_both"))
    return both.join(e, "early").join(x, "late").select("early", "late", "n_both", (F.col("n_early") - F.col("n_both")).alias("early_only"), (F.col("n_late") - F.col("n_both")).alias("late_only"))


def connect(clones: DataFrame, group: str, order: str | None = None, rule: str | None = None, ignore: list[str] | None = None, weighted: bool = False, key: str = "clone") -> DataFrame:
    """(src, dst, weight) between groups of one value of ``group``.

    Without ``order``: all ordered pairs.  With it: ``increase`` / ``decrease`` connect neighbours in (falling) order,
    ``all_increase`` / ``all_decrease`` each with all that follow.  The weight is 1, or 1 over the number of groups.
    A callable ``rule`` gets a frame of one value's rows and returns (i, j) positions of rows.
    """
    own = clones.where(F.col(group).isNotNull())
    if ignore:
        own = own.where(~F.col(group).cast("string").isin(ignore))
    size = F.count("*").over(Window.partitionBy(group))
    weight = (F.lit(1.0) / size if weighted else F.lit(1.0)).alias("weight")
    if callable(rule):
        import pandas as pd

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.reset_index(drop=True)
            pairs = [(rows[key][i], rows[key][j]) for i, j in rule(rows)]
            w = 1.0 / len(rows) if weighted else 1.0
            return pd.DataFrame({"src": [p[0] for p in pairs], "dst": [p[1] for p in pairs], "weight": w})

        kind = dict(own.dtypes)[key]
        return own.groupBy(group).applyInPandas(run, f"src {kind}, dst {kind}, weight double")
    if order is None:
        a = own.select(F.col(group).alias("g"), F.col(key).alias("src"), weight)
        b = own.select(F.col(group).alias("g"), F.col(key).alias("dst"))
        return a.join(b, "g").where("src <> dst").select("src", "dst", "weight")
    if rule not in ("increase", "decrease", "all_increase", "all_decrease"):
        raise ValueError(f"unknown rule {rule!r}")
    by: Column = F.col(order).desc() if rule.endswith("decrease") else F.col(order).asc()
    w = Window.partitionBy(group).orderBy(by, F.col(key))
    if not rule.startswith("all_"):
        return own.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst"), weight).where("dst is not null")
    ranked = own.select(F.col(group).alias("g"), F.col(key), F.row_number().over(w).alias("r"), weight)
    a, b = ranked.select("g", F.col(key).alias("src"), F.col("r").alias("ra"), "weight"), ranked.select("g", F.col(key).alias("dst"), F.col("r").alias("rb"))
    return a.join(b, "g").where("ra < rb").select("src", "dst", "weight")
