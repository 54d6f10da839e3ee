"""Sums and ranks within keys of any size: rows are dealt by ranges, and one row per range carries what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.sources.store import stored


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and stored, with ``_b``, the number of a row's range.

    A key that fills the table is many ranges, if what follows it in ``order`` tells its rows apart.
    """
    return stored(rows.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")


def sums_before(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``<value>_before`` for each of ``values``: its sum over the rows of the same key before this one.

    ``order`` tells the rows of a key apart.  Only keys that reach over a border of ranges have anything to carry, so that table
    has fewer rows than there are ranges.
    """
    ranged = in_ranges(rows, *key, *order)
    own = ranged.groupBy("_b", *key).agg(*[F.sum(v).alias(f"_c_{v}") for v in values])
    earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select("_b", *key, F.row_number().over(Window.partitionBy(*key).orderBy("_b")).alias("_nth"), *[F.sum(f"_c_{v}").over(earlier).alias(f"_c_{v}") for v in values])
    carried = carried.where("_nth > 1").drop("_nth")
    within = Window.partitionBy("_b", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(carried), ["_b", *key], "left")
    before = [(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.coalesce(f"_c_{v}", F.lit(0))).alias(f"{v}_before") for v in values]
    return out.select(*rows.columns, *before)


def values_before(rows: DataFrame, key: list[str], value: str, one_task: int = 500_000) -> tuple[DataFrame, bool]:
    """(key, value, n, n_before): each distinct value of a key, its rows, and the key's rows with a smaller value; and whether they are few.

    Equal values are counted before anything is sent, so ties that fill a key are one row.  Up to ``one_task`` distinct values of all
    keys (counted first) are summed by key; beyond it by ranges, so a key's values are many tasks' work.
    """
    counts = stored(rows.groupBy(*key, value).agg(F.count("*").alias("n")), "values")
    if counts.count() > one_task:
        return stored(sums_before(counts, key, [value], ["n"]), "ranks"), False
    before = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))), True


def with_average_ranks(rows: DataFrame, key: list[str], value: str, out: str, one_task: int = 500_000, hot: int = 100_000) -> DataFrame:
    """``rows`` with ``out``: ranks within the key from 1, equal values sharing the mean of theirs.

    Values that ``hot`` rows or more of a key share are few and get their rank by a broadcast; others by a broadcast too up to
    ``one_task`` distinct values, else by a shuffle in which no value has many rows.
    """
    table, few = values_before(rows, key, value, one_task)
    ranks = table.select(*key, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out), "n")
    keys = [*key, value]
    if few:
        return rows.join(F.broadcast(ranks.drop("n")), keys).select(*rows.columns, out)
    often = F.broadcast(ranks.where(F.col("n") >= hot).drop("n"))
    seldom = rows.join(often, keys, "left_anti").join(ranks.where(F.col("n") < hot).drop("n"), keys)
    return rows.join(often, keys).select(*rows.columns, out).unionByName(seldom.select(*rows.columns, out))


def quantiles(rows: DataFrame, key: list[str], value: str, shares: list[float], out: str = "quantiles", one_task: int = 500_000) -> DataFrame:
    """(key, out array): exact quantiles of a key's values with linear interpolation, in the order of ``shares``; no key's rows meet in one task."""
    table, few = values_before(rows, key, value, one_task)
    size = table.groupBy(*key).agg(F.sum("n").alias("_n"))
    near = F.broadcast if few or size.count() <= one_task else (lambda x: x)
    place = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares]

    def at(rank: Column) -> Column:
        """The value with so many rows before it."""
        return F.max(F.when(F.col("n_before") <= rank, F.col(value)))

    picked = [at(F.floor(p)).alias(f"_a{i}") for i, p in enumerate(place)] + [at(F.floor(p) + 1).alias(f"_b{i}") for i, p in enumerate(place)]
    got = table.join(near(size), key).groupBy(*key, "_n").agg(*picked)
    between = []
    for i, p in enumerate(place):
        a, step, t = F.col(f"_a{i}"), F.col(f"_b{i}") - F.col(f"_a{i}"), p - F.floor(p)
        between.append(F.when(t < 0.5, a + step * t).otherwise(F.col(f"_b{i}") - step * (1 - t)))
    return got.select(*key, F.array(*between).alias(out))
