"""Registered queries on keys and times that the small tables do not have, against their SQL."""

from datetime import datetime

import pytest

import __spark_entry__
from keelson.operators.cursor import Watermark, lag_ms


def _both(spark, folder, name, table):
    import duckdb

    got = __spark_entry__.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, got.collect())), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("micros", [261_499, 261_500, 261_702, 999_500, 0])
def test_lag_is_rounded_as_epoch_ms_is(spark, tmp_path, micros):
    spark.createDataFrame([(1, datetime(2024, 1, 30, 23, 59, 25, micros))], "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got, wanted = _both(spark, tmp_path, "quality_lag", "events")
    assert got == wanted


def test_lag_is_whole_milliseconds():
    assert lag_ms(Watermark(datetime(2024, 1, 25, 19, 45, 43, 702000)), datetime(2024, 2, 1)) == 533_656_298  # by seconds as a double 533_656_297


@pytest.mark.parametrize("name", ["quality_mismatches", "quality_sample"])
def test_ghosts_do_not_hide_missing_rows(spark, tmp_path, name):
    """Keys on both sides of a million, where TARGET's ghosts would have the keys of other orders."""
    rows = [(k, k % 7, "F", float(k), datetime(2024, 1, 1), "1-URGENT") for k in (*range(500), *range(1_000_000, 1_000_500))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got, wanted = _both(spark, tmp_path, name, "orders")
    assert got == wanted
