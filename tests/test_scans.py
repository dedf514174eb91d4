"""Chains read the tables once and go on from what the calendar bounds."""

import os

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_hourly_totals_reads_its_tables_once(spark):
    plan = driver.queries()["hourly_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "l_shipdate" not in plan
