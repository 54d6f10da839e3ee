import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from kinspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_whole_tables(spark, sf_dir, name):
    table = "pages" if name == "op6_url_filter" else "documents"
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.count() >= rows and __spark_entry__.queries()[name] is queries.QUERIES[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
