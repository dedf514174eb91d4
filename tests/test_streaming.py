"""Streams give what the batch operators give on the same rows."""

from datetime import datetime as dt, timedelta

import pytest
from marigrid.operators import resample, windows
from marigrid.streaming import series
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    rows = [(k, dt(2000, 1, 1) + timedelta(hours=h * (1 + k) + (90 if h > 30 else 0)), float(h)) for k in range(3) for h in range(60)]
    df = spark.createDataFrame(rows, "stn long, time timestamp_ntz, value double")
    for part in range(4):
        df.filter(F.pmod(F.dayofyear("time"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(path)
    return path, df


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream(spark, path, files=100):
    return spark.readStream.schema("stn long, time timestamp_ntz, value double").option("maxFilesPerTrigger", files).parquet(path)


def test_daily_means(spark, source):
    path, df = source
    got = drained(spark, series.daily_means(stream(spark, path), ["stn"], "value"), "days", "complete")
    expected = resample.to_step(df, ["stn"], ["value"])
    assert {(r.stn, r.time, r.value) for r in got.collect()} == {(r.stn, r.time, r.value) for r in expected.collect()}


def test_sessions(spark, source):
    path, df = source
    got = drained(spark, series.sessions(stream(spark, path), ["stn"]), "segments", "complete")
    expected = windows.sessions(df, ["stn"], 48).groupBy("stn", "segment").agg(F.min("time"), F.max("time"), F.count(F.lit(1)))
    assert {(r.stn, r["first"], r["last"], r.n) for r in got.collect()} == {(r[0], r[2], r[3], r[4]) for r in expected.collect()}


def test_gap_alerts(spark, source):
    path, df = source
    got = drained(spark, series.gap_alerts(stream(spark, path), "stn", 48), "gaps")
    expected = windows.gaps(df, ["stn"])
    assert {(r.stn, r.start, r.stop, r.hours) for r in got.collect()} == {(r.stn, r.start, r.stop, r.hours) for r in expected.collect()}


def test_disaggregation_keeps_state(spark, tmp_path):
    schema = "stn long, time timestamp_ntz, xk double, a double, loc double, scale double, acs_scale double, acs_shape double, b double, c double, v double"
    rows = [(k, dt(2000, 1, 1 + d), 0.05 * d, 0.5, 0.0, 0.3, 8.0, 0.8, 0.88, 0.01, 200.0) for k in range(2) for d in range(4)]
    path = str(tmp_path / "days")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    once = drained(spark, series.disaggregate(spark.readStream.schema(schema).parquet(path), "stn", "skewnorm"), "hours")
    assert once.count() == 2 * 4 * 24
    means = {(r.stn, r.d.day): r.m for r in once.groupBy("stn", F.to_date("time").alias("d")).agg(F.avg("ntr").alias("m")).collect()}
    assert all(means[k, 1 + d] == pytest.approx(0.05 * d, abs=0.06) for k in range(2) for d in range(4))
