import json
import os

import pytest
from marigrid import schema
from marigrid.plans import water
from marigrid.sources import readers, sinks
from pyspark.sql import functions as F


def put(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_and_tsv(spark, tmp_path):
    p = put(tmp_path / "a.csv", "time,value\n2000-01-01 00:00:00,1.5\n2000-01-01 01:00:00,NaN\n2000-01-01 02:00:00,\n")
    assert [r.value for r in readers.read_csv(spark, p, schema.LEVELS).orderBy("time").collect()] == [1.5, None, None]
    m = spark.createDataFrame([("m", "r1", "hist", 1.0, 2.0)], schema.MANIFEST)
    sinks.write_csv(m, str(tmp_path / "m.tsv"), sep="\t")
    assert readers.read_csv(spark, str(tmp_path / "m.tsv"), schema.MANIFEST, sep="\t").collect() == m.collect()


def test_preamble(spark, tmp_path):
    p = put(tmp_path / "t.csv", "Trend of station\n\nnotes, here\nYear, Month, Linear_Trend\n1990, 1, 0.25\n1990, 2, NaN\n")
    got = readers.read_csv_after_preamble(spark, p, ["Year", " Month", " Linear_Trend"], "a int, b int, c double").orderBy("Month")
    assert got.columns == ["Year", "Month", "Linear_Trend"] and [tuple(r) for r in got.collect()] == [(1990, 1, 0.25), (1990, 2, None)]


def test_fixed_width(spark, tmp_path):
    line = "  1950   1  -0.53"
    p = put(tmp_path / "n.txt", f"HEADER\n{line}\n  1950   2  10.01\n")
    assert readers.detect_widths(line) == [6, 4, 7]
    for widths in (None, [6, 4, 7]):
        got = readers.read_fixed_width(spark, p, ["year", "month", "nino34"], widths).orderBy("month")
        assert [tuple(r) for r in got.collect()] == [("1950", "1", "-0.53"), ("1950", "2", "10.01")]


def test_payloads(spark):
    rows = [("s", json.dumps({"data": [{"t": "2000-01-01 00:00", "v": "1.5"}, {"t": "2000-01-01 01:00", "v": ""}]})), ("p", json.dumps({"predictions": [{"t": "2000-01-01 00:00", "v": "2"}]})), ("e", json.dumps({"error": "none"})), ("n", None), ("x", "no json")]
    got = readers.read_series_payloads(spark.createDataFrame(rows, "stn string, payload string"))
    assert sorted((r.stn, r.value) for r in got.collect()) == [("p", 2.0), ("s", 1.5)]


def test_partitions_are_pruned_and_sorted(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 5).cast("double").alias("x"), F.expr("timestamp_ntz'1999-06-01' + make_dt_interval(cast(id as int))").alias("time"), F.col("id").cast("double").alias("v"))
    sinks.write_series(df, str(tmp_path / "s"), ["x"])
    back = readers.read_partitioned(spark, str(tmp_path / "s"), 2000, 2000)
    assert back.count() == df.filter("year(time) = 2000").count()
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()
    named = readers.with_name_parts(spark.read.parquet(str(tmp_path / "s")), ["head", "rest"], sep="-")
    assert named.select("head").distinct().collect()[0][0] == "part"


def test_many_paths_and_lookup(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(3).withColumn("b", F.lit(1)).write.parquet(str(tmp_path / "b"))
    got = readers.read_many(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert got.count() == 6 and got.filter("b is null").count() == 3
    sinks.write_lookup(got.select("id"), str(tmp_path / "c"), ["id"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6 and os.path.isdir(tmp_path / "c")


def test_decoding_and_metadata(spark):
    d = spark.createDataFrame([(1.5,), (0.05,), (4e5,)], "d double")
    assert [str(r[0]) for r in d.select(readers.decode_days(F.col("d"))).collect()] == ["1850-01-02 12:00:00", "None", "None"]
    df = spark.createDataFrame([(1.0, None, None), (1.0, None, 2.0), (2.0, None, None)], "x double, a double, b double")
    assert sinks.dense_points(df, ["x"], ["a", "b"]).count() == 2
    assert sinks.described(df, {"a": "metres"}).schema["a"].metadata == {"comment": "metres"}
    s = spark.createDataFrame([(1, 1.0, 2.0, "CA", -8, True), (2, 1.0, 2.0, "CA", -8, False)], schema.STATIONS)
    assert readers.tidal_stations(s).count() == 1
    assert readers.availability(spark, {"ok": ["a", "b"], "missing": []}).count() == 2


def test_grids_calendars_and_suffixes(spark, tmp_path):
    spark.createDataFrame([(350.0,), (10.0,), (180.0,)], "lon double").write.parquet(str(tmp_path / "g.parquet"))
    assert [r.lon for r in readers.read_grid(spark, str(tmp_path / "g.parquet"), ordered=True).collect()] == [-180.0, -10.0, 10.0]
    days = spark.createDataFrame([(2001, 1, 1), (2001, 2, 30), (2001, 12, 30), (2000, 7, 1), (2000, 12, 30), (2000, None, 1)], "y int, m int, d int")
    got = [str(r[0]) for r in days.select(readers.standard_date(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == ["2001-01-01", "2001-03-02", "2001-12-31", "2000-07-02", "2000-12-31", "None"]
    p = put(tmp_path / "a.csv", "a,b\n1,x\n2,\n")
    assert [tuple(r) for r in readers.scan_table(spark, p).orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert readers.scan_table(spark, str(tmp_path / "g.parquet")).count() == 3
    with pytest.raises(ValueError):
        readers.scan_table(spark, "a.nc")


def test_emission_file(spark, tmp_path):
    species = ", ".join(f"`{s}` double" for s in water.SPECIES)
    row = lambda year, first: (year, first, None, float("nan"), *([1.0] * (len(water.SPECIES) - 3)))
    lines = water.emission_lines(spark.createDataFrame([row(2010, -0.00004), row(2000, 1234567.25)], "year int, " + species), "SSP2")
    sinks.write_lines(lines, str(tmp_path / "scen"), ["part", "year"])
    (name,) = [n for n in os.listdir(tmp_path / "scen") if n.startswith("part")]
    text = (tmp_path / "scen" / name).read_text().split("\n")
    assert text[:7] == [" 2", " 11", " SSP2", " Description line 1", " Description line 2", "", " WORLD"]
    assert len(text[7]) == len(text[8]) == 24 * 11
    assert text[9] == f"{2000:11d} {1234567.25:10.4f}" + f" {'nan':>10}" * 2 + f" {1:10.4f}" * 20
    assert text[10].startswith(f"{2010:11d} ") and float(text[10][11:22]) == 0
    assert text[11:] == ["", "", ""]
    got = readers.read_fixed_width(spark, str(tmp_path / "scen"), ["year", *water.SPECIES]).filter(F.col("SF6").isNotNull())
    assert {r.year: r.FossilCO2 for r in got.collect()} == {"2000": "1234567.2500", "2010": text[10][11:22].strip()}
    assert [r.line for r in water.emission_lines(spark.createDataFrame([], "year int, " + species), "SSP1").filter("part in (0, 9)").collect()] == [" 0"]


def test_download_logs(spark, tmp_path):
    put(tmp_path / "a.yml", "# a log\nmid_search: true\nzos_day_2000.nc: ok\n'psl: day ''x''.nc': \"all: right\"\n? very_long.nc\n: failed\nempty:\nnone: null\n- item.nc\n  inner.nc: 1\nhttp://host:80/a.nc: done # really\n")
    put(tmp_path / "b.yml", "mid_search: false\n")
    put(tmp_path / "c.yml", "")
    logs = readers.read_download_logs(spark, str(tmp_path))
    got = {(r.path[-5:], r.key): r.value for r in logs.collect()}
    a = {"mid_search": "true", "zos_day_2000.nc": "ok", "psl: day 'x'.nc": "all: right", "very_long.nc": "failed", "empty": None, "none": None, "http://host:80/a.nc": "done # really"}
    assert {k: v for (p, k), v in got.items() if p == "a.yml"} == a
    counts = {r.path[-5:]: (r.n_files, r.missing) for r in readers.missing_logs(logs).collect()}
    assert counts["a.yml"] == (4, False) and counts["b.yml"] == (0, True)
    assert counts.get("c.yml", (0, True)) == (0, True)
