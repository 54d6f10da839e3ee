from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import embed
from kinspark.sources import matrices
from kinspark.sources.models import load_model, save_model
from kinspark.streaming.counts import project_stream, windowed_sizes


def test_datasets_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([(1, "a")], "cell long, clone string")
    expr = spark.createDataFrame([(1, "g", 2.0, "counts")], "cell long, gene string, value double, layer string")
    matrices.write_dataset(f"{tmp_path}/d", obs=obs, expr=expr)
    got = matrices.read_dataset(spark, f"{tmp_path}/d", "obs", "expr")
    assert got["obs"].collect() == obs.collect() and got["expr"].where("layer = 'counts'").count() == 1
    assert len(matrices.MURINE) == 16
    with pytest.raises(ValueError):
        matrices.write_dataset(f"{tmp_path}/e", nonsense=obs)
    with pytest.raises(ValueError):
        matrices.murine_development(spark, region="tail")


def test_compressed_columns(spark):
    entries = [(0, 2, 1.0), (1, 0, 2.0), (2, 1, 3.0)]
    i = spark.createDataFrame(entries, "k long, row long, value double")
    p = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3)], "col long, start long")
    assert {tuple(r) for r in matrices.from_pointers(i, p).collect()} == {(2, 0, 1.0), (0, 2, 2.0), (1, 2, 3.0)}
    c = spark.createDataFrame([(5, [1, 2], [0.5, 0.25])], "col long, i array<long>, x array<double>")
    assert {tuple(r) for r in matrices.from_compressed_columns(c).collect()} == {(1, 5, 0.5), (2, 5, 0.25)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nAC\n>s2\nGG\n")
    assert {tuple(r) for r in matrices.read_fasta(spark, f"{tmp_path}/a.fa").collect()} == {("s1", "ACGTAC"), ("s2", "GG")}
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n")
    assert [tuple(r) for r in matrices.read_tsv(spark, f"{tmp_path}/a.tsv", "a long, b string").collect()] == [(1, "x")]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("clone", F.col("user_id").cast("string"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windowed_sizes(stream, "ts", "clone").writeStream.format("memory").queryName("sizes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sizes").agg(F.sum("n_cells")).first()[0] == events.count()
    q = project_stream(stream, lambda b: b.groupBy("clone").count(), f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == events.count()


@dataclass
class Other:
    absent: int


def test_models_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    model = embed.EmbeddingModel(["a", "b"], ["x", "ü"], rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), rng.normal(size=2), None, [3.0, 2.5])
    save_model(spark, model, f"{tmp_path}/m")
    got = load_model(spark, embed.EmbeddingModel, f"{tmp_path}/m")
    assert got.rows == model.rows and got.cols == model.cols and got.history == model.history and got.row_bias is None
    assert np.array_equal(got.u, model.u) and np.array_equal(got.v, model.v) and np.array_equal(got.bias, model.bias)
    with pytest.raises(ValueError):
        load_model(spark, Other, f"{tmp_path}/m")
