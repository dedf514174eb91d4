import math

import numpy as np
import pytest

from marigrid.operators import homogeneity as hom


@pytest.mark.parametrize(("k", "h"), [(0.2, 0.3), (0.5, 1.0), (-0.1, 0.2), (0.1, -0.4), (1.0, 0.9)])
def test_kappa_by_its_ratios(k, h):
    t3, t4 = hom.ratios(k, h)
    # against L-moments of its quantiles
    u = (np.arange(400_000) + 0.5) / 400_000
    x = hom.kappa_quantiles(u, 0.0, 1.0, k, h)
    l1, l2, l3, l4 = x.mean(), (x * (2 * u - 1)).mean(), (x * (6 * u**2 - 6 * u + 1)).mean(), (x * (20 * u**3 - 30 * u**2 + 12 * u - 1)).mean()
    assert math.isclose(t3, l3 / l2, abs_tol=2e-3) and math.isclose(t4, l4 / l2, abs_tol=2e-3)
    fit = hom.fit_kappa(l1, l2, t3, t4)
    y = hom.kappa_quantiles(u, *fit)
    assert np.abs(np.quantile(y, [0.1, 0.5, 0.9]) - np.quantile(x, [0.1, 0.5, 0.9])).max() < 0.02


def test_published_ratios():
    # logistic (k 0, h -1), Gumbel (k 0, h 0), uniform (k 1, h 1)
    for (k, h), want in {(1e-9, -0.999999): (0.0, 1 / 6), (1e-9, 0.0): (0.1699, 0.1504), (1.0, 1.0): (0.0, 0.0)}.items():
        assert np.allclose(hom.ratios(k, h), want, atol=1e-3)


def test_regions_of_known_kind(spark):
    rng = np.random.default_rng(6)
    rows = [("alike", s, float(v)) for s in range(12) for v in rng.gumbel(10, 2, 80)]
    rows += [("scaled", s, float(v * (s + 1))) for s in range(12) for v in rng.gumbel(10, 2, 80)]  # l2 / l1 stays
    rows += [("apart", s, float(v)) for s in range(12) for v in rng.gumbel(10, 1 + s / 3, 80)]
    rows += [("single", 0, float(v)) for v in rng.gumbel(10, 2, 80)] + [("tiny", s, 1.0 + s) for s in range(3)] + [("null", 1, None)]
    df = spark.createDataFrame(rows, "region string, site int, v double").repartition(5)
    got = {r.region: r for r in hom.homogeneity(df, ["region"], ["site"], "v", 150).collect()}
    assert set(got) == {"alike", "scaled", "apart"} and all(r.sites == 12 for r in got.values())
    assert abs(got["alike"].h) < 2.5 and abs(got["scaled"].h) < 2.5 and got["apart"].h > 4
    again = {r.region: r.h for r in hom.homogeneity(df.repartition(2), ["region"], ["site"], "v", 150).collect()}
    assert all(math.isclose(again[k], r.h, rel_tol=1e-6) for k, r in got.items())
