"""Geometric sketching: a sample that covers the space evenly, from boxes of equal side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.operators.ranged import sums_before
from kinspark.sources.store import forget, stored

#: Sides that are tried in one pass: halves of the widest range first, then steps between two of these.
_HALVES, _STEPS = 16, 8


def _box(side: Column) -> Column:
    """The box of a row (x, low): its hash."""
    return F.xxhash64(F.transform("x", lambda v, i: F.floor((v - F.get("low", i)) / side)))


def _side(rows: DataFrame, sides: list[Column], wanted: str) -> DataFrame:
    """(_g, place): the first of the falling ``sides`` at which about as many boxes hold rows as are wanted, or the last one."""
    counts = rows.groupBy("_g").agg(F.first(wanted).alias("_w"), *[F.approx_count_distinct(_box(s), 0.02).alias(f"_n{i}") for i, s in enumerate(sides)])
    first = F.coalesce(*[F.when(F.col(f"_n{i}") >= F.col("_w"), F.lit(i)) for i in range(len(sides))], F.lit(len(sides) - 1))
    return counts.select("_g", first.alias("place"))


def sketch(points: DataFrame, n: float = 0.2, by: str | None = None, seed: int = 42, most_broadcast: int = 200_000) -> DataFrame:
    """(cell, gs) with gs ``sketch`` or ``full``; n in (0, 1] is a share of the rows, above 1 a number; per ``by`` value, null among them.

    The boxes' side is the largest of the tried ones at which as many boxes hold points as rows are wanted, by distinct counts right to some
    two per cent.  Of each box the row with the least seeded hash comes first, then all other rows by their hashes; the first rows in that
    order are taken, so the number is exact.  All ``by`` values share each pass: ranges, two passes of counts over sixteen and eight
    sides, first rows, and places in the order, which are summed by ranges.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit("null")) if by else F.lit("all")
    rows = points.select("cell", own.alias("_g"), F.col("x").cast("array<double>").alias("x"), F.xxhash64("cell", F.lit(seed)).alias("t"))
    spans = rows.select("_g", F.posexplode("x").alias("i", "v")).groupBy("_g", "i").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    spans = spans.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("low"), F.max(F.col("b") - F.col("a")).alias("width"))
    count = rows.groupBy("_g").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1), F.least(F.col("n"), F.round(F.col("n") * float(n)) if n <= 1 else F.lit(int(n)))).cast("long")
    info = stored(count.join(spans, "_g", "left").select("_g", share.alias("wanted"), F.col("low.a").alias("low"), (F.coalesce("width", F.lit(0.0)) + 1e-9).alias("width")), "spans")
    near = F.broadcast if info.count() <= most_broadcast else (lambda x: x)
    known = rows.join(near(info), "_g")
    half = _side(known, [F.col("width") * 2.0**-i for i in range(_HALVES)], "wanted")
    info2 = info.join(half, "_g").withColumn("side", F.col("width") * F.pow(F.lit(2.0), 1.0 - F.col("place"))).drop("place")
    info2 = stored(info2, "halves")
    known = rows.join(near(info2), "_g")
    step = _side(known, [F.col("side") * 2.0 ** (-(i + 1) / _STEPS) for i in range(_STEPS)], "wanted")
    info3 = stored(info2.join(step, "_g").withColumn("side", F.col("side") * F.pow(F.lit(2.0), -(F.col("place") + 1.0) / _STEPS)).drop("place"), "sides")
    boxed = stored(rows.join(near(info3), "_g").select("cell", "_g", "t", _box(F.col("side")).alias("box"), "wanted"), "boxes")
    first = boxed.groupBy("_g", "box").agg(F.min(F.struct("t", "cell")).alias("f")).select("_g", F.col("f.t").alias("t"), F.col("f.cell").alias("cell"), F.lit(0).alias("r"))
    placed = boxed.select("cell", "_g", "t", "wanted", F.lit(1).cast("long").alias("one")).join(first, ["_g", "t", "cell"], "left").withColumn("r", F.coalesce("r", F.lit(1)))
    out = sums_before(placed, ["_g"], ["r", "t", "cell"], ["one"])
    forget(info, info2)
    return out.select("cell", F.when(F.col("one_before") < F.col("wanted"), "sketch").otherwise("full").alias("gs"))
