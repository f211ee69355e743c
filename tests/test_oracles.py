"""Every query with SQL gives DuckDB's rows and column names."""

import os
import subprocess
import sys

import duckdb
import pytest

from tarnbrook.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})")
    assert sorted(duck.sql(registry.ORACLES[name]).columns) == columns
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(map(str, expected.fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lookup_filter_reaches_the_scan(spark, tmp_path):
    from tarnbrook.operators import ops

    spark.createDataFrame([("a", "h", "{}")], "id string, hash string, data_json string").write.parquet(str(tmp_path / "s"))
    plan = ops.get_by_id(spark.read.parquet(str(tmp_path / "s")), "a")._jdf.queryExecution().toString()
    assert "EqualTo(id,a)" in plan


def test_workers_need_no_path_to_the_package(tmp_path):
    """Queries in a session of its own, from another folder: what Python workers import is sent to them."""
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
from tarnbrook.plans import registry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("reset_keeps_target", "scan_skips_corrupt", "json_text_round_trip", "streaming_ingest"):
    print(name, registry.QUERIES[name](spark, {DATA!r}).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.count("True") == 4, out.stderr[-2000:]
