"""The driver contract, core plans and the streaming forms."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.streaming import live
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["annual_mean", "window_peak", "depth_aep", "pair_antecedent", "to_wide", "bus_components", "asset_states", "summarize_impacts",
                                  "select_catalog", "soil_infiltration", "rollup_gauges", "stream_impacts"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert compare(entry.queries()[name](spark, FOLDER), con.execute(entry.oracle_sql()[name])).startswith("ok")


@needs_data
@pytest.mark.parametrize("name", ["duration_depth", "event_peak_discharge", "depth_aep", "asset_impacts", "hydrograph_scores"])
def test_no_python_on_core_paths(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "CartesianProduct" not in plan


@needs_data
def test_scan_reads_only_used_columns(spark):
    plan = entry.queries()["season_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_shipdate" in plan and "l_comment" not in plan and "l_quantity" not in plan


def test_stream_sessions_on_batch_rows(spark):
    rows = [("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-01 00:30:00", 9.0), ("a", "2024-01-01 05:00:00", 7.0), ("a", "2024-01-01 05:10:00", 1.0)]
    df = spark.createDataFrame(rows, "series_id string, time string, value double").withColumn("time", F.to_timestamp("time"))
    got = live.stream_exceedance_sessions(df, 2.0, "1 hour").orderBy("session_start").collect()
    assert [(r.peak, r.exceedances) for r in got] == [(9.0, 2), (7.0, 1)]
