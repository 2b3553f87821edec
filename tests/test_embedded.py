"""Databases inside the driver's process, where executors are processes of their own."""

import json
import os
import subprocess
import sys

import pytest

from keelson.sources import embedded

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
NAMES = ("sink_jdbc_append", "sink_jdbc_delete", "sink_jdbc_evolve", "sink_jdbc_merge")
PROGRAM = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
at, data, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "1024m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
out = {}
for n in names:
    df = __spark_entry__.queries()[n](spark, data)
    out[n] = [df.columns, sorted(map(list, df.collect()), key=str)]
from keelson.sources import embedded
embedded.BATCH = 7  # more rows than one batch wait in files
url = "jdbc:derby:memory:batches;create=true"
spark.range(0).write.jdbc(url, "B")
embedded.append(spark.range(20), url, "B", {})
out["batches"] = sorted(r[0] for r in embedded.read(spark, url, "B", {}).collect())
print("OUT" + json.dumps(out))
spark.stop()
"""


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    at = tmp_path_factory.mktemp("cluster")
    said = subprocess.run([sys.executable, "-c", PROGRAM, str(at), DATA, *NAMES], cwd=at, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=300)
    lines = [x for x in said.stdout.splitlines() if x.startswith("OUT")]
    assert lines, said.stderr[-3000:]
    return json.loads(lines[0][3:])


def _expected(name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{DATA}/nation.parquet'")
    rows = con.execute(__spark_entry__.oracle_sql()[name])
    return [[c[0] for c in rows.description], sorted(map(list, rows.fetchall()), key=str)]


@pytest.mark.parametrize("name", NAMES)
def test_queries_on_a_cluster_equal_their_sql(found, name):
    assert found[name] == _expected(name)


def test_rows_come_in_batches(found):
    assert found["batches"] == list(range(20))


def test_which_databases_are_embedded():
    inside = ("jdbc:derby:memory:x;create=true", "jdbc:derby:/data/x", "jdbc:h2:mem:x", "jdbc:h2:~/x", "jdbc:sqlite:x", "jdbc:hsqldb:mem:x", "jdbc:duckdb:")
    served = ("jdbc:derby://h:1527/x", "jdbc:h2:tcp://h/x", "jdbc:hsqldb:hsql://h/x", "jdbc:mysql://h/x", "jdbc:postgresql://h/x")
    assert all(map(embedded.is_embedded, inside)) and not any(map(embedded.is_embedded, served))
