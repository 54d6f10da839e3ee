"""The driver's tables seen as cells, groups and long feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.sources.store import table

#: The same views in SQL, for oracles.
CELLS_SQL = """
cells as (
  select vec_id as cell, case when vec_id % 11 = 0 then 'NA' else 'c' || (vec_id % 37) end as clone, cast(label as varchar) as cell_type,
         'b' || (vec_id % 3) as batch, cast(embedding as double[]) as x
  from embeddings
)"""
EXPR_SQL = "expr as (select cell, 'g' || (i - 1) as gene, x[i] as value from (select cell, x, unnest(range(1, 65)) as i from cells))"


def knn_sql(k: int, queries: str = "true", index: str = "true", extra: str = "true") -> str:
    """Neighbours of labelled cells as CTE nn(q, n, d, r)."""
    return f"""nn as (
  select * from (
    select q, n, d, row_number() over (partition by q order by d, n) - 1 as r
    from (select a.cell as q, b.cell as n, list_distance(a.x, b.x) as d from cells a, cells b where ({queries}) and ({index}) and ({extra}))
  ) where r < {k}
)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """cell, clone (``NA`` for some), cell_type, batch, x."""
    clone = F.when(F.col("vec_id") % 11 == 0, "NA").otherwise(F.concat(F.lit("c"), (F.col("vec_id") % 37).cast("string")))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell"), clone.alias("clone"), F.col("label").cast("string").alias("cell_type"), F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("batch"), F.col("embedding").cast("array<double>").alias("x")
    )


def expr(spark: SparkSession, sf: str) -> DataFrame:
    """cell, gene, value: the coordinates of x as genes."""
    rows = cells(spark, sf).select("cell", F.posexplode("x").alias("i", "value"))
    return rows.select("cell", F.concat(F.lit("g"), F.col("i").cast("string")).alias("gene"), "value")


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """cell, clone, fate, value, label_1, label_2 of events."""
    e = table(spark, sf, "events")
    none = F.col("event_id") % 10 == 0
    return e.select(
        F.col("event_id").alias("cell"),
        F.col("user_id").cast("string").alias("clone"),
        F.col("event_type").alias("fate"),
        "value",
        F.when(none, "NA").otherwise(F.col("user_id").cast("string")).alias("label_1"),
        F.when(none | (F.col("event_id") % 3 == 0), None).otherwise((F.col("event_id") % 7).cast("string")).alias("label_2"),
        (F.col("event_id") % 4).cast("string").alias("split"),
    )


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("cell"), F.col("o_custkey").cast("string").alias("clone"), F.col("o_orderpriority").alias("fate"), F.col("o_orderstatus").alias("split"), "o_orderdate")
