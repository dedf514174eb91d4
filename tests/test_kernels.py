"""Numerical kernels against closed forms, published values and properties."""

from datetime import datetime as dt, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.functions import distributions as dist
from marigrid.functions.interp import pchip, spline
from marigrid.functions.optimize import nelder_mead
from marigrid.operators import disagg
from marigrid.params import Disaggregation


@pytest.mark.parametrize(("df", "p", "q"), [(10, 0.975, 2.228139), (5, 0.95, 2.015048), (30, 0.995, 2.749996), (3, 0.9, 1.637744)])
def test_student_quantiles(df, p, q):
    assert dist.ppf("t", np.array([p]), df, 0.0, 1.0)[0] == pytest.approx(q, abs=2e-6)


@pytest.mark.parametrize(("p", "z"), [(0.975, 1.959964), (0.5, 0.0), (0.999, 3.090232)])
def test_normal_quantiles(p, z):
    assert dist.ppf("norm", np.array([p]), 0.0, 1.0)[0] == pytest.approx(z, abs=2e-6)


def test_skew_normal_without_skew_is_normal():
    x = np.linspace(-4, 4, 41)
    np.testing.assert_allclose(dist.cdf("skewnorm", x, 0.0, 0.5, 2.0), dist.cdf("norm", x, 0.5, 2.0), atol=1e-12)


@pytest.mark.parametrize("a", [-50.0, -5.0, -0.7, 0.7, 5.0, 50.0])
def test_skew_normal_cdf_is_the_integral(a):
    x = np.linspace(-6, 6, 24001)
    f = np.exp(dist.logpdf("skewnorm", x, a, 0.0, 1.0))
    whole = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2) * (x[1] - x[0])])
    np.testing.assert_allclose(dist.cdf("skewnorm", x, a, 0.0, 1.0), whole, atol=2e-5)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["skewnorm", "t", "norm"]), st.floats(2.1, 30), st.floats(-5, 5), st.floats(0.01, 10), st.floats(0.002, 0.998))
def test_quantile_inverts_cdf(family, shape, loc, scale, p):
    params = ([] if family == "norm" else [shape]) + [loc, scale]
    assert dist.cdf(family, dist.ppf(family, np.array([p]), *params), *params)[0] == pytest.approx(p, abs=1e-4)


def test_fit_recovers_parameters():
    rng = np.random.default_rng(0)
    x = dist.ppf("skewnorm", rng.random(4000), 4.0, 1.0, 2.0)
    got = dist.fit("skewnorm", x)
    assert got["a"] == pytest.approx(4, rel=0.2) and got["loc"] == pytest.approx(1, abs=0.15) and got["scale"] == pytest.approx(2, rel=0.1)
    assert got["ks_pval"] > 0.5 and got["cvm_pval"] > 0.05 and got["record_length"] == 4000
    assert dist.fit("t", dist.ppf("t", rng.random(4000), 5.0, 0.0, 1.0))["df"] == pytest.approx(5, rel=0.3)


@pytest.mark.parametrize(("stat", "p"), [(0.46136, 0.05), (0.34730, 0.10), (0.74346, 0.01)])
def test_cramer_von_mises_tail(stat, p):
    assert dist.cvm_p(stat) == pytest.approx(p, abs=1e-3)


def test_f_tail():
    assert dist.f_sf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)


def test_spline_is_exact_for_cubics():
    x = np.array([0.0, 1, 2.5, 3, 5, 6.5])
    f = lambda t: 2 - t + 0.5 * t**2 + 0.3 * t**3
    at = np.linspace(0, 6.5, 50)
    np.testing.assert_allclose(spline(x, f(x), at), f(at), atol=1e-9)
    np.testing.assert_allclose(spline(x[:3], x[:3] ** 2, at[:10]), at[:10] ** 2, atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=12))
def test_pchip_stays_between_neighbours(y):
    y = np.array(y)
    x = np.arange(len(y), dtype=float)
    at = np.linspace(0, len(y) - 1, 97)
    got, i = pchip(x, y, at), np.minimum(at.astype(int), len(y) - 2)
    assert (got >= np.minimum(y[i], y[i + 1]) - 1e-9).all() and (got <= np.maximum(y[i], y[i + 1]) + 1e-9).all()


def test_nelder_mead():
    np.testing.assert_allclose(nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] - 0.2) ** 4, [1.0, 1.0]), [3, 0.2], atol=0.05)
    assert nelder_mead(lambda p: (p[0] + 1) ** 2, [1.0], low=0.05)[0] == pytest.approx(0.05)


def test_normal_target_keeps_correlations():
    np.testing.assert_allclose(disagg.correlation_points("norm", (0.0, 1.0)), disagg.RHO_Z, atol=1e-5)
    b, c = disagg.fit_curve(np.array(disagg.RHO_Z), np.array(disagg.RHO_Z))
    np.testing.assert_allclose(disagg.curve(np.array(disagg.RHO_Z), b, c), disagg.RHO_Z, atol=0.02)


def test_blocks():
    spec = Disaggregation()
    _, v = disagg.blocks_needed(np.sort(np.random.default_rng(0).standard_normal(1000)), spec)
    assert (v >= 1).all() and np.isfinite(v).all()
    assert (disagg.blocks_needed(np.ones(10), spec)[1] <= 2).all()  # nearly every draw hits


def test_autoregression_of_ar1():
    rho = 0.7 ** np.arange(1, 40)
    a, noise = disagg.autoregression(rho, None, from_zero=True)
    assert a[0] == pytest.approx(0.7, abs=1e-9) and np.abs(a[1:]).max() < 1e-9 and noise == pytest.approx(np.sqrt(1 - 0.49))
    assert disagg.autoregression(rho, 0)[1] == 1.0


def test_disaggregation_hits_daily_means_and_is_repeatable(spark):
    rows = [(m, dt(2000, 1, 1) + timedelta(days=d), float(0.1 * np.sin(d)) if d != 5 else None) for m in ("a", "b") for d in range(12)]
    days = spark.createDataFrame([(m, t, x, 0.5, 0.0, 0.3, 8.0, 0.8, 0.88, 0.01, 400.0) for m, t, x in rows], "model string, time timestamp_ntz, xk double, a double, loc double, scale double, acs_scale double, acs_shape double, b double, c double, v double")
    runs = [sorted(map(tuple, disagg.disaggregate(days.repartition(n), ["model"], "skewnorm").toPandas().fillna(-99).itertuples(index=False))) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 2 * 12 * 24
    for m, t, x in rows:
        hours = [r[2] for r in runs[0] if r[0] == m and r[1].date() == t.date()]
        if x is None:
            assert set(hours) == {-99}
        else:
            assert np.mean(hours) == pytest.approx(x, abs=0.05)


def test_curve_needs_whole_points():
    rho = np.array(disagg.RHO_Z)
    for bad in (np.nan, np.inf, -0.01):
        assert np.isnan(disagg.fit_curve(np.where(np.arange(len(rho)) == 3, bad, rho), rho)).all()


def test_blocks_in_chunks_are_as_good(monkeypatch):
    rho = 0.6 ** np.arange(1, 49)
    x, z = disagg.best_block(np.random.default_rng(1), 0.03, 30_000, "norm", (0.0, 1.0), rho, np.zeros(0), Disaggregation())
    assert abs(x.mean() - 0.03) < 1e-3 and len(x) == len(z) == 24
    monkeypatch.setattr(disagg, "CHUNK", 7)
    y, _ = disagg.best_block(np.random.default_rng(1), 0.03, 2000, "norm", (0.0, 1.0), rho, np.zeros(0), Disaggregation())
    assert abs(y.mean() - 0.03) < 0.01


def test_a_day_goes_on_from_the_gaussian_values_of_the_last():
    from marigrid.operators import disagg
    from marigrid.params import Disaggregation

    spec, rho = Disaggregation(lags=6), 0.9 ** np.arange(1, 7)
    across = {}
    for gaussian in (False, True):
        rng, state, last, pairs = np.random.default_rng(5), None, None, []
        for _ in range(1500):
            x, state = disagg.best_block(rng, 0.0, 1, "norm", (0.0, 1.0), rho, state, spec, True, gaussian)
            if last is not None:
                pairs.append((last, x[0]))
            last = x[-1]
        across[gaussian] = np.corrcoef(np.array(pairs).T)[0, 1]
    assert abs(across[True] - 0.9) < 0.05
    assert across[False] < across[True]
