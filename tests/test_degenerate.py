"""Groups that define nothing (constant, collinear, tiny, zero) cost their own values only."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigrid.functions import scalar
from marigrid.operators import acf, stats, windows
from marigrid.params import Window
from marigrid.plans import water

GROUPS = {
    "constant": [(5.0, 5.0, 5.0, 5.0)] * 6,
    "zero": [(0.0, 0.0, 0.0, 0.0)] * 6,
    "collinear": [(i, 2.0 * i, 3.0 * i + 1, 4.0 * i) for i in map(float, range(1, 7))],
    "perfect": [(float(i), float(i * i % 5), float(i % 3), float(i)) for i in range(1, 9)],
    "one": [(1.0, 2.0, 3.0, 4.0)],
    "two": [(1.0, 2.0, 3.0, 4.0), (2.0, 1.0, 0.0, -4.0)],
    "three": [(1.0, 2.0, 3.0, 4.0), (2.0, 1.0, 0.0, -4.0), (0.5, 0.1, 7.0, 0.0)],
    "nulls": [(None, None, None, None), (1.0, None, 2.0, 3.0)],
    "fine": [tuple(map(float, r)) for r in np.random.default_rng(0).normal(size=(40, 4))],
}


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(g, i, *r) for g, many in GROUPS.items() for i, r in enumerate(many)]
    at = F.make_timestamp_ntz(F.lit(1999), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.expr("make_dt_interval(i)")
    return spark.createDataFrame(rows, "g string, i int, a double, b double, c double, y double").withColumn("time", at)


def by_group(df):
    return {r["g"]: r.asDict() for r in df.collect()}


def test_regressions(groups):
    got = by_group(stats.ols3(groups, ["g"], ["a", "b", "c"], "y"))
    assert all(got[g]["r2"] is None and got[g]["m_a"] is None for g in ("constant", "zero", "collinear", "one", "two"))
    x = np.array(GROUPS["fine"])
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    m, *_ = np.linalg.lstsq(np.c_[z, np.ones(len(z))], x[:, 3], rcond=None)
    assert np.allclose([got["fine"][k] for k in ("m_a", "m_b", "m_c", "b")], m)
    one = stats.ols(groups, ["g"], "a", "y")
    f = by_group(one.select("g", stats.f_statistic(F.col("r2"), F.col("n")).alias("f"), stats.f_p_value(stats.f_statistic(F.col("r2"), F.col("n")), F.lit(1), F.col("n") - 2).alias("p")))
    assert f["perfect"]["f"] is None and f["constant"]["f"] is None and f["one"]["p"] is None
    assert 0 <= f["fine"]["p"] <= 1


def test_metrics(groups):
    got = by_group(stats.fit_metrics(groups, ["g"], "a", "y"))
    assert got["constant"]["rmse"] == 0 and got["constant"]["nse"] is None and got["constant"]["pearson"] is None
    assert got["zero"]["ned"] is None and got["zero"]["relative_mse"] is None
    assert got["three"]["nse_rel"] is None and got["three"]["rmse"] > 0  # an observed 0
    o, s = (np.array(GROUPS["fine"])[:, k] for k in (3, 0))
    assert math.isclose(got["fine"]["nse"], 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum())
    assert math.isclose(got["fine"]["pearson"], np.corrcoef(s, o)[0, 1])
    assert math.isclose(got["fine"]["nse_rel"], 1 - (((s - o) / o) ** 2).sum() / (((o - o.mean()) / o.mean()) ** 2).sum())


def test_l_moments(groups):
    moments = stats.l_moments(groups, ["g"], "y")
    got = by_group(moments)
    assert [got["one"][f"l{k}"] is None for k in range(1, 5)] == [False, True, True, True]
    assert [got["three"][f"l{k}"] is None for k in range(1, 5)] == [False, False, False, True]
    assert got["zero"]["l1"] == 0
    assert stats.dispersion(moments.withColumn("r", F.lit(1)), ["r"]).collect()[0].n > 0


def test_chains(spark, groups):
    assert by_group(acf.empirical_acf(groups, ["g"], "a", 2, 48, drop_edges=False)).keys() >= {"fine"}
    assert windows.window_ols3(groups, Window(1999, 1999), ["g"], ["a", "b", "c"], "y").filter("g = 'collinear' AND r2 IS NOT NULL").count() == 0
    days = groups.filter("i < 6").dropna()
    st = water.day_of_year_stats(days, ["g"], ["a"])
    got = water.bias_corrected(days, st, st, ["g"], ["a"]).collect()
    assert {r.a_corrected for r in got if r.g == "constant"} == {None}
    assert all(math.isclose(r.a_corrected, r.a, abs_tol=1e-9) for r in got if r.g == "fine")
    q = stats.quantile_table(groups.dropna(), ["g"], "a")
    assert {r.change for r in water.percent_change(q, q, ["g"]).collect() if r.g == "zero"} == {None}
    assert by_group(water.regional_index(days, "a", 1.0, ["g"])) == {}


def test_curves(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.5), (1.0, 2.0, 0.0), (0.5, 0.0, 1.0), (3.0, 2.0, 0.5)], "lag double, s double, k double")
    for f in (scalar.weibull_acf, scalar.pareto_acf, scalar.transformation_curve, lambda lag, s, k: scalar.burr_acf(lag, s, k, k)):
        assert rows.select(f(F.col("lag"), F.col("s"), F.col("k")).alias("v")).collect()[3].v is not None


def test_baseline(spark):
    rows = [("a", y, float(y)) for y in range(1990, 2005)] + [("late", y, 7.0) for y in range(2000, 2003)] + [("gap", y, 3.0) for y in (1990, 2001)]
    got = {(r.k, r.year): r.value for r in water.baseline_kept(spark.createDataFrame(rows, "k string, year int, value double"), ["k"], 1995, 1999).collect()}
    # from the baseline's end on, not from its start
    assert [got["a", y] for y in (1995, 1998, 1999, 2004)] == [1995.0, 1998.0, 1997.0, 1997.0]
    assert {got["late", y] for y in range(2000, 2003)} == {0.0}
    assert got["gap", 1990] == 3.0 and got["gap", 2001] is None


@pytest.mark.parametrize("buckets", [2, 64])
def test_selected_quantiles_equal_percentile(spark, buckets):
    rng = np.random.default_rng(7)
    rows = [("ties", float(v)) for v in rng.integers(0, 4, 500)] + [("tail", float(v)) for v in rng.pareto(1.1, 700)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 5.0), ("same", 5.0), ("same", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    wanted = {(r.g, r.level): r.q for r in stats.quantile_table(df, ["g"], "v").collect() if r.q is not None}
    got = {(r.g, r.level): r.q for r in stats.select_quantiles(df, ["g"], "v", buckets=buckets).collect()}
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k], wanted[k], rel_tol=1e-12) for k in got)
    assert stats.select_quantiles(df, [], "v", [0.0, 0.5, 1.0], buckets).count() == 3
