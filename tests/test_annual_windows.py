"""Fits and autocorrelation in annual windows, and the chain that they feed, against one window at a time."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marigrid.functions import distributions as dist
from marigrid.operators import acf, disagg, grid, joins, resample
from marigrid.params import Disaggregation, Window
from marigrid.plans import chain

HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def center(year, month_day):
    try:
        return dt.datetime(year, int(month_day[:2]), int(month_day[2:]))
    except ValueError:
        return dt.datetime(year, 3, 1)


def inside(rows, window, month_day, match):
    spans = [(center(y, month_day) - window.half * DAY, center(y, month_day) + window.half * DAY) for y in range(window.first, window.last + 1)]
    return [r for r in rows if any(a <= r[0] <= b for a, b in spans) and (match == "interval" or r[0].time() == dt.time(0))]


def brute_acf(series, window, month_day, lags, gap, match):
    """The pairs of all series of one key, each parted at gaps, without its first row and the rows before gaps."""
    pairs = {k: [] for k in range(1, lags + 1)}
    for rows in series:
        held = sorted(inside(rows, window, month_day, match))
        breaks = [i for i in range(len(held) - 1) if (held[i + 1][0] - held[i][0]) > gap * HOUR]
        ends = [*breaks, len(held)]
        for s, e in zip([1, *(i + 1 for i in ends[:-1])], ends, strict=True):
            v = [r[1] for r in held[s:e]]
            for k in pairs:
                pairs[k] += list(zip(v[:-k], v[k:], strict=False)) if k < len(v) else []
    out = []
    for k, p in pairs.items():
        if len(p) < 2 or np.std([a for a, _ in p]) < 1e-9 or np.std([b for _, b in p]) < 1e-9:
            continue
        r = np.corrcoef(*zip(*p, strict=True))[0, 1]
        if r < 0:
            break
        out.append((k, round(float(r), 7), len(p)))
    return out


@pytest.mark.parametrize(("match", "gap", "lags"), [("interval", 6, 5), ("interval", 30, 8), ("instant", 60, 4)])
def test_window_acf(spark, match, gap, lags):
    rng = random.Random(gap)
    window, start = Window(1999, 2001, 4), dt.datetime(1998, 12, 25)
    series = {}
    for cell in ((0, 1), (0, 2), (1, 1)):
        v, rows = 0.0, []
        for h in range(0, 24 * 800):
            v = 0.9 * v + rng.gauss(0, 1)
            if rng.random() < (0.9 if (h // 400) % 3 else 0.03):  # stretches with many gaps and few rows
                rows.append((start + h * HOUR + (dt.timedelta(minutes=20) if rng.random() < 0.1 else 0 * HOUR), 100 + v))
        series[cell] = rows
    table = spark.createDataFrame([(x, y, t, v) for (x, y), rows in series.items() for t, v in rows] + [(0, 1, start, None)], "x int, y int, time timestamp_ntz, ntr double").repartition(5)
    got = {}
    for r in acf.window_acf(table, window, ["x"], ["x", "y"], "ntr", lags, gap, match=match).collect():
        got.setdefault((r.x, r.center_day), []).append((r.lag, round(r.acf, 7), r.pairs))
    days = [(dt.date(1980, 1, 1) + i * DAY).strftime("%m%d") for i in range(366)]
    want = {(x, d): brute_acf([rows for c, rows in series.items() if c[0] == x], window, d, lags, gap, match) for x in (0, 1) for d in days}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize(("match", "block"), [("instant", 31), ("interval", 7)])
def test_window_marginals(spark, match, block):
    rng = random.Random(2)
    window = Window(1999, 2001, 6)
    rows = {k: [(dt.datetime(1999, 1, 1) + 12 * i * HOUR, rng.gauss(k, 1 + k)) for i in range(2 * 400) if rng.random() < 0.6 and not 100 < i < 140] for k in (0, 1)}
    table = spark.createDataFrame([(k, t, v) for k, many in rows.items() for t, v in many] + [(0, dt.datetime(1999, 5, 5), None)], "k int, time timestamp_ntz, v double").repartition(3)
    got = {}
    for r in disagg.window_marginals(table, window, ["k"], "v", "skewnorm", match=match, block=block).collect():
        got.setdefault((r.k, r.center_day), {})[r.param] = r.value
    days = [(dt.date(1980, 1, 1) + i * DAY).strftime("%m%d") for i in range(366)]
    for k, d in itertools.product((0, 1), days):
        x = np.array([v for _, v in sorted(inside(rows[k], window, d, match))])
        assert got.get((k, d), {}).get("record_length", 0) == (len(x) if len(x) > 2 else 0)
        if len(x) > 2 and d.endswith(("01", "29")):
            assert got[k, d] == dist.fit("skewnorm", x)


@pytest.mark.parametrize(("n", "m"), [(5, 5), (4, 7), (6, 3), (1, 1), (6, 4)])
def test_ks_is_exact(n, m):
    """All orders of the joint sample are alike; count those with a gap at least as large."""
    lcm = math.lcm(n, m)
    gaps = []
    for chosen in itertools.combinations(range(n + m), n):
        at, most, own = 0, 0, set(chosen)
        for i in range(n + m):
            at += lcm // n if i in own else -(lcm // m)
            most = max(most, abs(at))
        gaps.append(most)
    for h in range(lcm + 1):
        assert math.isclose(dist.ks_outside(n, m, h), sum(g >= h for g in gaps) / len(gaps), abs_tol=1e-12)


def test_ks_published():
    # critical values of the two-sample test: P(D >= 8/10) at n = m = 10 and P(D >= 9/20) at n = m = 20
    assert math.isclose(dist.ks_outside(10, 10, 8), 0.0021, abs_tol=5e-5)
    assert math.isclose(dist.ks_outside(20, 20, 9), 0.0335, abs_tol=5e-5)
    rng = np.random.default_rng(1)
    a, b = rng.random(3000), rng.random(2999)
    assert 0 < dist.ks_p(a, a[::-1] + 1e-9) <= 1 and 0 < dist.ks_p(a, b) < 1


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_nearest_in_buckets(spark, buckets):
    rng = random.Random(3)
    table = [(k, round(rng.paretovariate(1.2), 2), i) for i in range(300) for k in (1, 2)] + [(1, 5.0, 999), (1, 5.0, 1001)]
    asked = [(i, rng.choice([1, 2, 3, None]), rng.choice([rng.uniform(-5, 60), 5.0, round(rng.uniform(0, 9), 2)])) for i in range(400)]
    q = spark.createDataFrame(asked, "id int, k int, at double").repartition(4)
    got = {r.id: (r.nearest, r.v) for r in joins.nearest(q, spark.createDataFrame(table, "k int, value double, v int"), ["k"], "at", "value", ["v"], buckets).collect()}
    for i, k, at in asked:
        own = [(abs(at - x), x) for kk, x, _ in table if kk == k]
        if k is None:
            assert i not in got
        elif not own:
            assert got[i] == (None, None)
        else:
            x = min(own)[1]
            assert got[i] == (x, max(v for kk, y, v in table if (kk, y) == (k, x)))


def test_chain(spark):
    """Observed hours of known memory, projected days of more spread: hours keep the days' means, the memory and the spread's ratio."""
    rng = np.random.default_rng(5)
    start = dt.datetime(1999, 1, 1)
    v, hours = 0.0, []
    for h in range(24 * 120):
        v = 0.9 * v + math.sqrt(1 - 0.81) * rng.normal()
        hours.append((1, start + h * HOUR, 0.1 * v))
    observed = spark.createDataFrame(hours, "stn int, time timestamp_ntz, ntr double")
    spread = np.array([h[2] for h in hours]).reshape(-1, 24).mean(1).std()
    days = [(1, dt.datetime(2005, 2, 1) + i * DAY, float(0.05 + 1.2 * spread * rng.normal())) for i in range(40)]
    projected = spark.createDataFrame(days, "stn int, time timestamp_ntz, ntr double")
    every = projected.select("stn", F.explode(F.sequence(F.col("time"), F.col("time") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("time"))
    spec = Disaggregation(lags=12)
    out = chain.hourly_totals(observed, projected, every.withColumn("tides", F.lit(0.25)), projected.select("stn", "time", F.lit(1.5).alias("msl")), ["stn"], Window(1999, 1999), Window(2005, 2005), spec=spec)
    rows = out.orderBy("time").collect()
    assert len(rows) == 40 * 24
    assert all(math.isclose(r.twl, 1.75 + r.ntr, abs_tol=1e-6) for r in rows)
    x = np.array([r.ntr for r in rows]).reshape(40, 24)
    wanted = np.array([d[2] for d in days])
    # most days' means are within the tolerance; the rest lie beyond the simulated range
    assert np.median(np.abs(x.mean(1) - wanted)) < 0.05 * 1.2 * spread
    within = x - x.mean(1, keepdims=True)
    seen = np.array([h[2] for h in hours]).reshape(-1, 24)
    seen = seen - seen.mean(1, keepdims=True)
    lag1 = lambda a: (a[:, 1:] * a[:, :-1]).mean() / (a * a).mean()
    assert abs(lag1(within) - lag1(seen)) < 0.2


@pytest.mark.parametrize(("block", "rows"), [(5, 3), (5, 5), (4, 9), (1 << 16, 3)])
def test_series_end_to_end_in_blocks(spark, monkeypatch, block, rows):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(block + rows)
    table = [(k, j, i, rng.random() if rng.random() < 0.9 else None) for k in (1, 2, 3, None) for j in (1, 2) for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame(table, "k int, j int, time int, v double").repartition(4)
    got = {(r.k, r.j, r.time): r.low for r in resample.low_and_high(df, ["k", "j"], "v", rows, by_group=False).collect()}
    laid = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, (k, j, at, _) in enumerate(laid):
        held = [r[3] for r in laid[max(0, i - rows + 1) : i + 1]]
        want = sum(held) / rows if len(held) == rows and None not in held else None
        assert (got[k, j, at] is None) == (want is None) and (want is None or math.isclose(got[k, j, at], want))
    assert len(got) == len(table)


def test_window_cells(spark):
    cells = [(float(x), float(y)) for x in range(0, 12, 2) for y in range(5) if (x, y) != (4, 2)]
    got = {tuple(r) for r in grid.window_cells(spark.createDataFrame([*cells, cells[0]], "x double, y double"), 2).collect()}
    assert got == {(*a, *b) for a in cells for b in cells if abs(a[0] - b[0]) <= 2 and abs(a[1] - b[1]) <= 2}
    one = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in grid.window_cells(one, 3).collect()] == [(3.0, 4.0, 3.0, 4.0)]


@pytest.mark.parametrize("stored", [True, False])
def test_packed_lookup(spark, stored):
    table = [(0.1, 0.2, 0.3, 7.0), (0.1, 0.2, 0.3, 5.0), (0.1, 0.201, -0.7, 9.0), (1.0, 0.0005, 0.0015, 4.0)]
    asked = [(0, 0.1, 0.2, 0.3), (1, 0.1001, 0.19999, 0.3), (2, 0.1, 0.2, 1.3), (3, 1.0, 0.0, 0.002), (4, None, 0.2, 0.3), (5, 0.1, 0.201, -0.7), (6, 5.0, 5.0, 5.0)]
    cache = spark.createDataFrame(table, "a double, b double, c double, d double")
    got = {r.i: r.d for r in joins.lookup_packed(spark.createDataFrame(asked, "i int, a double, b double, c double"), cache, ["a", "b", "c"], "d", stored=stored).collect()}
    pack = lambda v: tuple(round(x * 1000) for x in v)
    key = (lambda v: pack(v)[0] * 10**9 + pack(v)[1] * 10**6 + pack(v)[2]) if stored else pack
    for i, *v in asked:
        hits = [d for *k, d in table if None not in v and key(k) == key(v)]
        assert got[i] == (min(hits) if hits else None)
    assert got[0] == 5.0 and got[6] is None
