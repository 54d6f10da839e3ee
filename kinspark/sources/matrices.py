"""Sources of cells and matrices: folders of Parquet, compressed columns, TSV, FASTA; a catalogue; sinks."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a stored dataset; absent ones are optional.
PARTS = ("obs", "var", "expr", "obsm", "obsp", "uns")


def write_dataset(path: str, mode: str = "error", **tables: DataFrame) -> None:
    """Tables of a dataset below one folder; ``expr`` with a layer column is partitioned by it."""
    for name, df in tables.items():
        if name not in PARTS:
            raise ValueError(f"unknown part {name!r}")
        out = df.write.mode(mode)
        (out.partitionBy("layer") if "layer" in df.columns else out).parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, *parts: str) -> dict[str, DataFrame]:
    """The named parts of a dataset written by :func:`write_dataset`."""
    return {p: spark.read.parquet(f"{path}/{p}") for p in parts}


def in_vitro(spark: SparkSession, path: str = "data/in_vitro", *parts: str) -> dict[str, DataFrame]:
    """A hematopoiesis dataset stored in this layout; nothing is downloaded."""
    return read_dataset(spark, path, *(parts or ("obs", "expr")))


#: (perturbed, region, subset) -> folder name of the murine development datasets.
MURINE = {
    (perturbed, region, subset): f"{'perturbed' if perturbed else 'control'}_{region}_{subset}"
    for perturbed, region, subset in product((False, True), ("trunk", "head"), ("all", "mesenchyme", "neurons", "other"))
}


def murine_development(spark: SparkSession, root: str = "data", perturbed: bool = False, region: str = "trunk", subset: str = "all", *parts: str) -> dict[str, DataFrame]:
    """One of sixteen datasets, by condition, region and subset."""
    if (perturbed, region, subset) not in MURINE:
        raise ValueError(f"no dataset for {(perturbed, region, subset)}")
    return read_dataset(spark, f"{root}/{MURINE[perturbed, region, subset]}", *(parts or ("obs", "expr")))


def from_compressed_columns(columns: DataFrame) -> DataFrame:
    """(row, col, value) of a matrix held by columns: (col, i array of row numbers, x array of values)."""
    return columns.select("col", F.explode(F.arrays_zip("i", "x")).alias("e")).select(F.col("e.i").alias("row"), "col", F.col("e.x").alias("value"))


def from_pointers(i: DataFrame, p: DataFrame) -> DataFrame:
    """(row, col, value) of the three vectors of a column-compressed matrix.

    ``i``: (k, row, value) by position; ``p``: (col, start), the pointers with one more at the end.  Each entry's column is the
    last one that starts at or before its position: columns' ranges are spread to blocks of positions, joined, and checked.
    """
    block = 1 << 16
    from pyspark.sql import Window

    ends = p.withColumn("stop", F.lead("start").over(Window.orderBy("col"))).where("stop > start")
    ranges = ends.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    entries = i.withColumn("b", F.floor(F.col("k") / block))
    return entries.join(ranges, "b").where("k >= start and k < stop").select("row", "col", "value")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record; a record's lines are joined."""
    text = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r"))
    name = F.regexp_extract("r", r"^([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")
    return text.where("r <> ''").select(name.alias("name"), body.alias("sequence"))
