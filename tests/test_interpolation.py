"""Interpolation in column expressions against the numpy kernels, which the spline's and the cubics' properties hold for."""

import datetime as dt
import random

import numpy as np
import pytest

from marigrid.functions.interp import pchip as pchip_kernel
from marigrid.functions.interp import spline as spline_kernel
from marigrid.operators import interpolate

START = dt.datetime(2000, 1, 3)
SCHEMA = "model string, x int, time timestamp_ntz, v double"


def seconds(t):
    return (t - START).total_seconds()


def series(seed, n, missing=()):
    rng = random.Random(seed)
    days = sorted(rng.sample(range(200), n))
    return [(START + dt.timedelta(days=d), None if i in missing else rng.gauss(0, 1)) for i, d in enumerate(days)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 30])
def test_cubic(spark, n):
    rows = series(n, n + 1, {0})
    table = spark.createDataFrame([("a", 1, t, v) for t, v in rows], SCHEMA)
    got = sorted((r.time, r.v) for r in interpolate.cubic(table, ["model", "x"], "v").collect())
    known = [(t, v) for t, v in rows if v is not None]
    at = [known[0][0] + dt.timedelta(days=i) for i in range((known[-1][0] - known[0][0]).days)]
    assert [t for t, _ in got] == at
    if n > 1:
        want = spline_kernel(np.array([seconds(t) for t, _ in known]), np.array([v for _, v in known]), np.array([seconds(t) for t in at]))
        np.testing.assert_allclose([v for _, v in got], want, atol=1e-8)


def test_pchip_judges_the_whole_cube(spark):
    # one cell of model b ends early on a steep slope: going on beyond its range leaves the cube's
    flat = [(START + dt.timedelta(days=10 * i), 0.5 + 0.1 * (i % 2)) for i in range(12)]
    steep = [(START + dt.timedelta(days=10 * i), 0.01 * i * i) for i in range(8)] + [(t, None) for t, _ in flat[8:]]
    lone = [(START + dt.timedelta(days=30), 0.4)]
    rows = [("a", 1, t, v) for t, v in flat] + [("b", 1, t, v) for t, v in flat] + [("b", 2, t, v) for t, v in steep] + [("b", 3, t, v) for t, v in lone]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in interpolate.pchip(table, ["model", "x"], "v", cube=["model"]).collect():
        got.setdefault((r.model, r.x), []).append((r.time, r.v))
    at = [START + dt.timedelta(hours=i) for i in range(110 * 24 + 1)]
    assert all(sorted(t for t, _ in v) == at for v in got.values())
    x = np.array([seconds(t) for t in at])
    values = {k: np.array([np.nan if v is None else v for _, v in sorted(many, key=lambda p: p[0])]) for k, many in got.items()}
    ft, fv = np.array([seconds(t) for t, _ in flat]), np.array([v for _, v in flat])
    np.testing.assert_allclose(values["a", 1], pchip_kernel(ft, fv, x), atol=1e-9)
    np.testing.assert_allclose(values["b", 1], np.interp(x, ft, fv), atol=1e-9)  # the other cell's fault, but one cube
    st = np.array([seconds(t) for t, v in steep if v is not None])
    want = np.where(x <= st[-1], np.interp(x, st, [v for _, v in steep if v is not None]), np.nan)
    np.testing.assert_allclose(values["b", 2], want, atol=1e-9)
    assert np.isnan(values["b", 3]).all()
    # within the tolerance, pieces go on beyond the known range
    wide = interpolate.pchip(table, ["model", "x"], "v", cube=["model"], tolerance=10.0)
    late = {r.time: r.v for r in wide.filter("model = 'b' AND x = 2").collect()}
    np.testing.assert_allclose([late[t] for t in at], pchip_kernel(st, np.array([v for _, v in steep if v is not None]), x), atol=1e-8)


def test_no_rows(spark):
    table = spark.createDataFrame([("a", 1, START, None)], SCHEMA)
    assert interpolate.pchip(table, ["model", "x"], "v").count() == 0 and interpolate.cubic(table, ["model", "x"], "v").count() == 0
