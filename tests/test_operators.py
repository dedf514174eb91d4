"""Edges that the test tables lack, and the steps whose stored rule differs from the plain one."""

from datetime import datetime as dt, timedelta

import numpy as np
import pytest
from marigrid.functions import scalar
from marigrid.operators import acf, calendar, disagg, grid, joins, resample, stats, windows
from marigrid.params import BBox, Compat, Window
from marigrid.plans import water
from marigrid.schema import nan_to_null
from pyspark.sql import functions as F


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_nan_becomes_null(spark):
    df = nan_to_null(rows(spark, [(float("nan"), 1), (2.0, 2), (None, 3)], "v double, k long"))
    assert df.agg(F.avg("v"), F.count("v")).first() == (2.0, 1)


@pytest.mark.parametrize(("x", "wrapped"), [(180.0, -180.0), (359.9, -0.1), (-180.0, -180.0), (0.0, 0.0), (540.0, -180.0), (-181.0, 179.0)])
def test_longitude(spark, x, wrapped):
    assert spark.range(1).select(scalar.wrap_longitude(F.lit(x))).first()[0] == pytest.approx(wrapped)


def test_box_edges_are_in(spark):
    df = rows(spark, [(0.0, 0.0), (1.0, 1.0), (1.0001, 1.0)], "x double, y double")
    assert df.filter(scalar.in_box(F.col("x"), F.col("y"), BBox(0, 0, 1, 1))).count() == 2


def test_rounding_is_half_even(spark):
    assert str(spark.range(1).select(scalar.key4(F.lit(0.00025))).first()[0]) == "0.0002"


def test_leap_day_center(spark):
    got = {(r.center_day, r.center.year): r.center for r in calendar.centers(spark, Window(1999, 2000)).collect()}
    assert got["0229", 1999] == dt(1999, 3, 1) and got["0229", 2000] == dt(2000, 2, 29) and len(got) == 732


def test_windows_by_instant_and_interval(spark):
    hours = rows(spark, [(dt(2000, 5, 1) + timedelta(hours=h),) for h in range(-24 * 20, 24 * 20)], "time timestamp_ntz")
    w = Window(2000, 2000, 30)
    at = lambda how: {r[0].replace(year=2000) for r in windows.annual_window(hours, w, match=how).filter("center_day = '0501'").select("time").collect()}
    instant, interval = at("instant"), at("interval")
    assert len(instant) == 31 and all(t.hour == 0 for t in instant)
    assert len(interval) == 30 * 24 + 1 and min(interval) == dt(2000, 4, 16) and max(interval) == dt(2000, 5, 16)
    noon = rows(spark, [(dt(2000, 5, 1, 12) + timedelta(days=d),) for d in range(-20, 20)], "time timestamp_ntz")
    assert windows.annual_window(noon, w, match="instant").filter("center_day = '0501'").count() == 0
    assert windows.annual_window(noon, w, match="interval").filter("center_day = '0501'").count() == 30


def test_pooled_moments_equal_raw_windows(spark):
    days = rows(spark, [(dt(1996, 1, 1) + timedelta(days=d), 1e6 + (d * 7 % 31)) for d in range(1461)], "time timestamp_ntz, v double")
    w = Window(1996, 1999, 10)
    pooled = {r.center_day: r for r in windows.pooled_moments(days, w, [], ["v"]).collect()}
    raw = windows.annual_window(days, w).groupBy("center_day").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    assert len(raw) == 366
    for r in raw:
        p = pooled[r.center_day]
        assert (p.n, p.v_mean, p.v_std) == (r.n, pytest.approx(r.m), pytest.approx(r.s, rel=1e-6))


def test_gap_of_exactly_the_bound_stays(spark):
    t = [dt(2000, 1, 1), dt(2000, 1, 3), dt(2000, 1, 5, 1)]
    got = windows.sessions(rows(spark, [("a", x) for x in t], "k string, time timestamp_ntz"), ["k"], 48).orderBy("time")
    assert [r.segment for r in got.collect()] == [0, 0, 1]


def test_points_on_edges_are_in_no_cell(spark):
    cells = grid.cells(rows(spark, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "x double, y double"))
    points = rows(spark, [(0.5, 0.0), (0.4999, 0.0), (1.2, 0.9), (-0.5, 0.0), (9.0, 9.0)], "lon double, lat double")
    got = {(r.lon, r.x, r.y) for r in joins.points_in_cells(points, cells, 1.0).collect()}
    assert got == {(0.4999, 0.0, 0.0), (1.2, 1.0, 1.0)}


def test_descending_and_uneven_axes(spark):
    a = rows(spark, [(x,) for x in (4.0, 1.0, 2.0)], "x double")
    assert sorted(map(tuple, grid.axis_bounds(a, "x").collect())) == [(1.0, 0.5, 1.5), (2.0, 1.5, 3.0), (4.0, 3.0, 5.0)]
    assert grid.spacing(a, "x").first()[0] == 1.5


def test_nearest_ties_go_down(spark):
    table = rows(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    asked = rows(spark, [("a", 2.0, 1), ("a", 2.01, 2), ("a", -9.0, 3), ("a", 9.0, 4), ("c", 1.0, 5), ("a", 3.0, 6)], "k string, q double, i long")
    got = {r.i: r.nearest for r in joins.nearest(asked, table, ["k"], "q", "v").collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 1.0, 4: 3.0, 5: None, 6: 3.0}


def test_key_miss_is_null(spark):
    table = rows(spark, [(0.1 + 0.2, 7)], "p double, v long")
    got = joins.lookup_exact(rows(spark, [(0.3, 1), (0.4, 2), (None, 3)], "p double, i long"), table, ["p"])
    assert {r.i: r.v for r in got.collect()} == {1: 7, 2: None, 3: None}


def test_regridding_keeps_constants(spark):
    src = rows(spark, [(float(x), float(y)) for x in range(6) for y in range(5)], "x double, y double")
    dst = rows(spark, [(x * 1.7, y * 1.3) for x in range(3) for y in range(3)], "x double, y double")
    v = src.withColumn("time", F.lit(1)).withColumn("v", F.when((F.col("x") == 1) & (F.col("y") == 1), None).otherwise(F.lit(4.25)))
    got = grid.regrid(v, grid.overlap_weights(grid.cells(src), grid.cells(dst)), "v").collect()
    assert len(got) == 9 and all(r.v == pytest.approx(4.25) for r in got)


def test_rolling_across_groups_or_not(spark):
    df = rows(spark, [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("b", 2, 7.0)], "k string, time long, v double")
    stored = resample.low_and_high(df, ["k"], "v", 2, by_group=False).orderBy("k", "time").collect()
    plain = resample.low_and_high(df, ["k"], "v", 2).orderBy("k", "time").collect()
    assert [r.low for r in stored] == [None, 2.0, 4.0, 6.0]
    assert [r.low for r in plain] == [None, 2.0, None, 6.0]


def test_acf_edges_and_lags(spark):
    rng = np.random.default_rng(0)
    v = np.cumsum(rng.standard_normal(60))
    t = [dt(2000, 1, 1) + timedelta(hours=int(h) + (100 if h >= 30 else 0)) for h in range(60)]
    df = rows(spark, [("a", x, float(y)) for x, y in zip(t, v, strict=True)], "k string, time timestamp_ntz, v double")
    got = acf.empirical_acf(df, ["k"], "v", 3, 48).orderBy("lag").collect()
    parts = [v[1:29], v[30:]]  # the first row and the row before the gap are left out
    for r in got:
        a = np.concatenate([p[: -r.lag] for p in parts])
        b = np.concatenate([p[r.lag :] for p in parts])
        assert (r.acf, r.pairs) == (pytest.approx(np.corrcoef(a, b)[0, 1]), len(a))
    holes = df.filter("hour(time) <> 5")
    by_rows = acf.empirical_acf(holes, ["k"], "v", 1, 48).first().pairs
    by_steps = acf.empirical_acf(holes, ["k"], "v", 1, 48, gaps_count=True).first().pairs
    assert by_steps < by_rows


def test_three_regressors_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3)) @ [[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2]] + 5
    y = x @ [1.5, -2, 0.25] + rng.standard_normal(200)
    df = rows(spark, [("g", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [("one", 1.0, 1.0, 1.0, 2.0)], "k string, a double, b double, c double, y double")
    got = {r.k: r for r in stats.ols3(df, ["k"], ["a", "b", "c"], "y").collect()}
    z = (x - x.mean(0)) / x.std(0)
    beta, *_ = np.linalg.lstsq(np.column_stack([z, np.ones(200)]), y, rcond=None)
    r = got["g"]
    np.testing.assert_allclose([r.m_a, r.m_b, r.m_c, r.b], beta, rtol=1e-9)
    assert r.r2 == pytest.approx(1 - ((y - np.column_stack([z, np.ones(200)]) @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["one"].n == 1


def test_bias_correction_of_equal_statistics_is_identity(spark):
    df = rows(spark, [(0.0, dt(2000, 1, 1) + timedelta(days=d), float(d % 17)) for d in range(700)], "x double, time timestamp_ntz, v double")
    st = water.day_of_year_stats(df, ["x"], ["v"])
    got = water.bias_corrected(df, st, st, ["x"], ["v"]).collect()
    assert len(got) == 700 and all(r.v_corrected == pytest.approx(r.v) for r in got)


def test_stored_and_plain_regressions(spark):
    one = {"uas": 2.0, "uas_corrected": 3.0, "vas_corrected": -2.0, "psl_corrected": 1.0, "m_tauu": 1.0, "m_tauv": 10.0, "m_slp": 0.0, "b": 0.5}
    one |= {f"{p}_{n}": v for n in ("tauu", "tauv", "slp") for p, v in (("z_mean", 0.0), ("z_std", 1.0), ("min", -1.0), ("max", 1.0))}
    df = spark.createDataFrame([one])
    stored = water.high_frequency(df).first()
    plain = water.high_frequency(df, Compat(tauu_corrected=True, tauv_own_slope=True, extrapolated_either_side=True)).first()
    assert (stored.ntr_hf, stored.extrap_hf) == (6.0 - 4.0 + 0.5, False)
    assert (plain.ntr_hf, plain.extrap_hf) == (9.0 - 40.0 + 0.5, True)


def test_mean_level_algebra(spark):
    cube = rows(spark, [(0.0, 0.0, dt(2000, m, 1), 0.1 * m, 0.05 * m) for m in range(1, 7)], "x double, y double, time timestamp_ntz, zos double, zostoga double")
    yearly = rows(spark, [(2000, 0.4, 0.3)], "year int, te double, im double")
    m, r = 0.05, (0.3 - 0.05) / (0.4 - 0.05)
    for row in water.mean_level(cube, yearly).collect():
        z = 0.05 * row.time.month - m
        assert row.msl - row.zos == pytest.approx(z + z * r + 2 * m)


def test_shifts(spark):
    df = rows(spark, [("loc", 1.0, 2.0, 5.0), ("scale", 2.0, 4.0, 6.0), ("a", 99.0, 0.0, 0.0), ("a", 1.0, 1.0, 2.0)], "param string, hourly_obs double, daily_obs double, daily_cmip double")
    assert [r.hourly_cmip for r in water.shifted_parameters(df, "skewnorm").collect()] == [4.0, 3.0, 50.0, 2.0]
    t = rows(spark, [("df", 4.0, 8.0, 16.0), ("df", 1.0, 150.0, 2.5)], "param string, hourly_obs double, daily_obs double, daily_cmip double")
    assert [r.hourly_cmip for r in water.shifted_parameters(t, "t").collect()] == [8.0, 2.1]


def test_row_index_needs_no_global_order(spark):
    df = rows(spark, [(i % 7, i) for i in range(100)] + [(None, 5)], "a long, b long")
    got = windows.with_row_index(df, "a", ["b"])
    assert [r.row_index for r in got.orderBy(F.col("a").asc_nulls_first(), "b").collect()] == list(range(101))


def test_interpolation_is_clamped(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 1.0, 3.0))), F.array(*map(F.lit, (5.0, 7.0, 1.0)))
    at = lambda v: spark.range(1).select(scalar.interpolate(F.lit(v), xs, ys)).first()[0]
    assert [at(v) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0)] == [5.0, 5.0, 6.0, 7.0, 4.0, 1.0, 1.0]


def test_lookup_plans(spark):
    """Month-day lookups broadcast their 366 rows; instant windows don't shuffle the series."""
    big = rows(spark, [(dt(2000, 1, 1), 1)], "time timestamp_ntz, id long")
    plan = windows.annual_window(big, Window(2000, 2000))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_p_value_of_f(spark):
    from marigrid.operators import stats

    rows = spark.createDataFrame([(4.964602743730712, 1, 10), (4.04265212, 1, 48), (3.0, 1, 0), (None, 1, 5)], "f double, d1 int, d2 int")
    got = [r.p for r in rows.select(stats.f_p_value(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == pytest.approx(0.05, abs=1e-4) and got[2:] == [None, None]


def test_moments_far_from_zero(spark):
    """Values whose spread is small beside their size keep their deviation."""
    from marigrid.plans import water

    rows = [(1.0, 1.0, dt(2001, 1, 1) + timedelta(days=d), 1e9 + d % 2) for d in range(730)]
    df = spark.createDataFrame(rows, "x double, y double, time timestamp_ntz, v double")
    got = water.day_of_year_stats(df, ["x", "y"], ["v"]).filter("dayofyear = 200").first()
    assert got.v_std == pytest.approx(0.5, abs=1e-3) and got.v_mean == pytest.approx(1e9 + 0.5, abs=0.1)
    wide = water.day_of_year_stats(df.unionByName(df.withColumn("x", F.lit(5.0))), ["x", "y"], ["v"], neighbours=1).filter("dayofyear = 200").collect()
    assert len(wide) == 2 and all(r.v_mean == pytest.approx(got.v_mean) for r in wide)


def test_cells_masks_and_axes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, None), (1.0, 0.0, 2.0), (1.0, 0.0, 3.0)], "x double, y double, v double")
    assert {(r.x, r.v) for r in grid.complete_cells(df, ["v"]).collect()} == {(1.0, 2.0), (1.0, 3.0)}
    assert grid.outside_mask(df, spark.createDataFrame([(1.00001, 0.0)], "x double, y double")).count() == 2
    axis = spark.createDataFrame([(0.0,), (2.0,), (5.0,)], "x double")
    points = spark.createDataFrame([(1.0,), (3.6,), (99.0,), (None,)], "x double")
    assert [r.x for r in grid.snapped(points, axis, "x").collect()] == [0.0, 5.0, 5.0, None]
    box = BBox(0, 0, 0.5, 0.5)
    ok = lambda ocean, x: grid.central_location(ocean, df, x, 0.0, box).first().ok
    assert ok(df, 0.5) and not ok(df, 1.5) and not ok(df.filter("x = 1"), 0.5) and not ok(df.limit(0), 0.5)


def test_burr_fit_and_dispersion(spark):
    lags = [(1, k, (1 + 0.8 * (k / 5.0) ** 0.9) ** (-0.8 / 0.9)) for k in range(1, 40)]
    got = disagg.fit_acf(spark.createDataFrame(lags, "s int, lag int, acf double"), ["s"], "burrXII").first()
    assert got.mae < 3e-3  # the simplex stops in a kink of the absolute error
    sites = spark.createDataFrame([(1, 10.0, 2.0, 0.5, 0.2, 30), (1, 20.0, 2.0, 0.5, 0.2, 10)], "g int, l1 double, l2 double, l3 double, l4 double, n int")
    r = stats.dispersion(sites, ["g"]).first()
    assert (r.l1, r.l2, r.n) == (12.5, 2.0, 40) and abs(r.t1 - 0.175) < 1e-12 and abs(r.v - (0.025**2 * 0.75 + 0.075**2 * 0.25)) < 1e-12
